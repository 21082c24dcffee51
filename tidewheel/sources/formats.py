"""Sources and sinks: each query writes a table in a format and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder
from tidewheel.sources.segments import Segments
from tidewheel.streaming.arrivals import settings


_CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _round_trip(spark, sf_dir, kind, **options):
    rows = table(spark, sf_dir, "customer")
    folder = new_folder(spark, kind)
    rows.write.format(kind).options(**options).save(folder)
    return spark.read.format(kind).schema(rows.schema).options(**options).load(folder)


@query(_CUSTOMER_SQL)
def source_parquet(spark, sf_dir):
    return _round_trip(spark, sf_dir, "parquet", compression="zstd")


@query(_CUSTOMER_SQL)
def source_orc(spark, sf_dir):
    return _round_trip(spark, sf_dir, "orc")


@query(_CUSTOMER_SQL)
def source_json(spark, sf_dir):
    return _round_trip(spark, sf_dir, "json")


@query(_CUSTOMER_SQL)
def source_csv(spark, sf_dir):
    return _round_trip(spark, sf_dir, "csv", header="true")


#: Rows of an XML file: a file of it is read whole by one task, however large.
XML_ROWS = 100_000


@query(_CUSTOMER_SQL)
def source_xml(spark, sf_dir):
    return _round_trip(spark, sf_dir, "xml", rowTag="customer", maxRecordsPerFile=str(XML_ROWS))


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y FROM orders WHERE year(o_orderdate) = 1997")
def source_partitioned(spark, sf_dir):
    """Written in a folder for each year, by several tasks each; the filter prunes folders."""
    folder = new_folder(spark, "orders")
    table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")).repartition(F.col("y"), F.pmod(F.xxhash64("o_orderkey"), F.lit(4))).write.partitionBy("y").parquet(folder)
    return spark.read.parquet(folder).filter("y = 1997").select("o_orderkey", "y")


def _segments(spark, rows, folder):
    spark.dataSource.register(Segments)
    rows.write.format("segments").mode("append").save(folder)


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE value > 20 AND user_id <= 60 AND event_type <> 'error'")
def source_custom(spark, sf_dir):
    """``events`` by a sink of one's own and read back by its source, in segments by user: two filters are pushed into it and skip segments, the third is Spark's."""
    folder = new_folder(spark, "segments")
    _segments(spark, table(spark, sf_dir, "events").repartitionByRange(8, "user_id"), folder)
    with settings(spark, {"spark.sql.python.filterPushdown.enabled": "true"}):
        told = spark.read.format("segments").load(folder).filter("value > 20D AND user_id <= 60L AND event_type <> 'error'")
        told = told.select("event_id", "ts", "user_id", "event_type", "value")
        told._jdf.queryExecution().executedPlan()  # planned while the setting holds
    return told


@query("SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_custom(spark, sf_dir):
    """The same source as a stream: two commits, each read by a run that goes on where the last one ended."""
    folder, events = new_folder(spark, "segments"), table(spark, sf_dir, "events")
    for part in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        _segments(spark, part, f"{folder}/table")
        rows = spark.readStream.format("segments").load(f"{folder}/table").select("event_type", "value")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema("event_type string, value double").parquet(f"{folder}/out")
    return told.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Buckets of both sides of the bucketed join.
BUCKETS = 8


def bucketed(rows, key: str, name: str, n: int = BUCKETS):
    """``rows`` as a table in n buckets of ``key``, a sorted file each; a new name each time, in the session's catalogue."""
    spark, name = rows.sparkSession, f"{name}_{uuid.uuid4().hex}"
    # a task for each bucket writes it whole, so that a bucket is one file and its order is kept
    rows.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", new_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


@query("""
SELECT o_orderkey, count(l_orderkey)::BIGINT AS n, round(coalesce(sum(l_extendedprice), 0), 2) AS price FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def join_bucketed(spark, sf_dir):
    """Both sides are written in buckets of the key: joining and grouping by it need no exchange."""
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "orders")
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice"), "l_orderkey", "lines")
    joined = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 2).alias("price"))


@query("""
SELECT y, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM (SELECT year(l_shipdate)::INTEGER AS y, l_quantity FROM lineitem)
WHERE y IN (SELECT year(o_orderdate) FROM orders WHERE o_totalprice > (SELECT 0.9 * max(o_totalprice) FROM orders)) GROUP BY y
""")
def join_pruned(spark, sf_dir):
    """Which folders of the large side are read follows at run time from the rows that the small side keeps."""
    folder = new_folder(spark, "pruned")
    salted = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    salted.repartition(F.col("y"), F.pmod(F.xxhash64("l_orderkey"), F.lit(8))).write.partitionBy("y").parquet(f"{folder}/lines")
    orders = table(spark, sf_dir, "orders")
    most = orders.agg(F.max("o_totalprice").alias("most"))
    orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.max("o_totalprice").alias("dearest")).write.parquet(f"{folder}/years")
    years = spark.read.parquet(f"{folder}/years").filter(F.col("dearest") > 0.9 * F.lit(most.first()[0]))
    lines = spark.read.parquet(f"{folder}/lines")
    return lines.join(F.broadcast(years), F.col("y") == F.col("year")).groupBy("y").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))

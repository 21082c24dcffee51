"""Queries over the relational tables, each beside its SQL; the modules named last add theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import ORACLE_SQL, QUERIES, query, table

@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc,
  count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("2000-09-02 00:00:00").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum("l_extendedprice").alias("sum_base_price"),
            F.round(F.sum(price * (1 - disc)), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 - disc) * (1 + tax)), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


@query("SELECT l_orderkey, l_partkey, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')")
def filter_project(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R"))
    return rows.select("l_orderkey", "l_partkey", (F.col("l_quantity") * 2).alias("twice"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS band, json_extract_string(props, '$.k') AS k FROM events")
def case_and_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") > 50, "high").otherwise("low").alias("band"), F.get_json_object("props", "$.k").alias("k")
    )


@query("""
SELECT n_name, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def join_inner(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_left(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("lines"))


@query("SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey")
def join_semi(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n, grouping_id(o_orderpriority, o_orderstatus)::BIGINT AS g FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def group_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts, round(stddev(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.5), 6) AS mid FROM lineitem GROUP BY l_returnflag")
def group_statistics(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.round(F.stddev("l_quantity"), 6).alias("sd"), F.round(F.median("l_quantity"), 6).alias("mid")
    )


@query("""
SELECT o_orderpriority, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS f, (count(*) FILTER (o_orderstatus = 'O'))::BIGINT AS o
FROM orders GROUP BY o_orderpriority
""")
def group_pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).count()
    return wide.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("""
SELECT o_custkey, o_orderkey, r::INTEGER AS r FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3
""")
def top_per_group(spark, sf_dir):
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(by_price).alias("r")).filter("r <= 3")


@query("""
SELECT event_id, user_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after,
  round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS last_three
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"),
        F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("last_three"),
    )


@query("""
WITH marked AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM numbered GROUP BY user_id, session
""")
def sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 30 MINUTES"), 0).otherwise(1)
    numbered = table(spark, sf_dir, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
SELECT p.event_id, v.event_id AS prior FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type <> 'purchase') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_as_of(spark, sf_dir):
    """One sort by key and time over both sides; no inequality join."""
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase").rowsBetween(Window.unboundedPreceding, 0)
    prior = F.last(F.when(F.col("event_type") != "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, sf_dir, "events").withColumn("prior", prior).filter("event_type = 'purchase'").select("event_id", "prior")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey AS k FROM customer")
def intersect_all(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersectAll(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey AS k FROM lineitem")
def except_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")))


@query("SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey AS k FROM lineitem")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).union(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))).distinct()


@query("SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY md5(text)")
def exact_copies(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    by = F.window("ts", "1 hour")
    out = table(spark, sf_dir, "events").groupBy(by, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "mean")


@query("""
SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem l
WHERE l_quantity > 1.8 * (SELECT avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)
""")
def above_part_average(spark, sf_dir):
    """The correlated subquery as one aggregate over a window, so lineitem is read and shuffled once."""
    mean = F.avg("l_quantity").over(Window.partitionBy("l_partkey"))
    return table(spark, sf_dir, "lineitem").withColumn("m", mean).filter("l_quantity > 1.8D * m").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


from tidewheel.functions import scalars, texts, udfs  # noqa: E402, F401
from tidewheel.operators import aggregates, joins, metrics, ordered, ranges, sampling, selection, sets, sketches, windows  # noqa: E402, F401
from tidewheel.sources import formats  # noqa: E402, F401
from tidewheel.streaming import late, state, streams  # noqa: E402, F401

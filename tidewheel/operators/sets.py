"""Set operations, sorts, limits, predicates and samples beyond the catalogue's."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder



def _keys(spark, sf_dir, name, column):
    return table(spark, sf_dir, name).select(F.col(column).alias("k"))


@query("SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey AS k FROM lineitem")
def union_all(spark, sf_dir):
    return _keys(spark, sf_dir, "orders", "o_orderkey").union(_keys(spark, sf_dir, "lineitem", "l_orderkey"))


@query("SELECT c_custkey AS k, c_acctbal AS balance, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True).select("k", "balance", "nation")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_nationkey < 10")
def intersect_distinct(spark, sf_dir):
    some = table(spark, sf_dir, "customer").filter("c_nationkey < 10").select(F.col("c_custkey").alias("k"))
    return _keys(spark, sf_dir, "orders", "o_custkey").intersect(some)


@query("SELECT l_orderkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey AS k FROM orders")
def except_all(spark, sf_dir):
    return _keys(spark, sf_dir, "lineitem", "l_orderkey").exceptAll(_keys(spark, sf_dir, "orders", "o_orderkey"))


def placed(rows, name: str, *order):
    """``rows`` with ``name``: the place of each, from 1, in the order of all. Ranges of rows are sorted and counted, and a count for each range is joined back: no task sees all rows."""
    spark = rows.sparkSession
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = new_folder(spark, "placed")
    # an id has the number of its range in the upper bits and its place within the range in the others
    rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(folder)
    told = spark.read.parquet(folder).withColumn("_range", F.shiftright("_id", 33))
    sizes = told.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    before = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return told.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before", "_id")


@query("""
WITH t AS (SELECT c_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS x FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, x, (row_number() OVER (ORDER BY x ASC NULLS LAST, c_custkey))::BIGINT AS up, (row_number() OVER (ORDER BY x DESC NULLS FIRST, c_custkey))::BIGINT AS down FROM t
""")
def sort_nulls(spark, sf_dir):
    """Where nulls go in a sort, told by the places of all customers; those without such an order have none."""
    own = _dearest(spark, sf_dir).select("c_custkey", "x")
    return placed(placed(own, "up", F.asc_nulls_last("x"), F.asc("c_custkey")), "down", F.desc_nulls_first("x"), F.asc("c_custkey"))


def _dearest(spark, sf_dir):
    """Of each customer the dearest order of status F, x, and of any, y; null where there is none."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("x"), F.max("o_totalprice").alias("y"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(30).limit(20)


@query("""
WITH t AS (SELECT c_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS x, max(o_totalprice) AS y FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
SELECT c_custkey, x IS NULL AS missing, x IS NOT DISTINCT FROM y AS same, coalesce(x, y, 0) AS known, nullif(y, x) AS other FROM t
""")
def null_predicates(spark, sf_dir):
    rows = _dearest(spark, sf_dir)
    return rows.select("c_custkey", F.col("x").isNull().alias("missing"), F.col("x").eqNullSafe(F.col("y")).alias("same"), F.coalesce("x", "y", F.lit(0.0)).alias("known"), F.nullif("y", "x").alias("other"))


@query("SELECT p_partkey, p_name FROM part WHERE (p_size < 10 OR p_retailprice > 1500) AND p_type LIKE '%S%' AND NOT p_brand LIKE '%1'")
def filter_or_like(spark, sf_dir):
    own = (F.col("p_size") < 10) | (F.col("p_retailprice") > 1500)
    return table(spark, sf_dir, "part").filter(own & F.col("p_type").like("%S%") & ~F.col("p_brand").like("%1")).select("p_partkey", "p_name")


@query()
def sample_documents(spark, sf_dir):
    """Bernoulli and stratified samples; which rows are in depends on partitions, so no SQL tells them."""
    documents = table(spark, sf_dir, "documents")
    return documents.sample(0.1, seed=42).select("doc_id").unionByName(documents.sampleBy("lang", {"en": 0.1, "fr": 0.3}, seed=7).select("doc_id"))

"""An inequality, alone or beside an equality, counted without meeting any pair.

Both sides become distinct values with counts, are dealt to tasks by ranges of value, and running
counts inside a range are added to the totals of the ranges before it, one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder


def count_smaller(asked: DataFrame, a: str, rows: DataFrame, b: str, name: str, ranges: int | None = None, by: tuple[str, str] | None = None) -> DataFrame:
    """``asked`` and ``name``: how many of ``rows`` have ``b`` smaller than the row's ``a``.

    Null values of b count nowhere; a null a gets null. NaN is larger than any other number, and no smaller
    than itself. Values are doubles. A value that many rows have is one row with a count before it is dealt.
    ``by`` names a column of each side that must be equal as well: rows of that group alone count, and a null
    group gets null. Ranges are of group and value, so that a large group has many of them.
    """
    spark = asked.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = ["k"] if by else []

    def valued(side: DataFrame, value: str, group: tuple[str, ...]) -> DataFrame:
        told = side.select(*[F.col(g).alias("k") for g in group], F.col(value).cast("double").alias("v"))
        return told.filter(" AND ".join(f"{c} IS NOT NULL" for c in told.columns))

    own = valued(rows, b, by[1:] if by else ()).groupBy(*k, "v").agg(F.count("*").alias("n"))
    wanted = valued(asked, a, by[:1] if by else ()).distinct().withColumn("n", F.lit(0).cast("long"))
    values = own.unionByName(wanted).groupBy(*k, "v").agg(F.sum("n").alias("n"))
    folder = new_folder(spark, "ranges")
    # written once: ranges come from a sample, and a task that is done again must find the same
    values.repartitionByRange(ranges, *k, "v").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/values")
    values = spark.read.parquet(f"{folder}/values")
    before = Window.partitionBy(*k).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range, and group in it
    totals = values.groupBy(*k, "part").agg(F.sum("n").alias("all")).select(*[F.col(c).alias("g") for c in k], F.col("part").alias("p"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*k, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, [F.col("part") == F.col("p"), *[F.col(c) == F.col("g") for c in k]])
    ranks = ranks.select(*[F.col(c).alias("_k") for c in k], F.col("v").alias("_v"), (F.col("inside") + F.col("before")).alias("_n"))
    kept = [asked[c] for c in asked.columns]
    on = [asked[a].cast("double") == F.col("_v"), *[asked[by[0]] == F.col("_k") for _ in k]]
    return asked.join(ranks, on, "left").select(*kept, F.col("_n").alias(name))


@query("SELECT s_suppkey, count(c_custkey)::BIGINT AS poorer FROM supplier LEFT JOIN customer ON c_acctbal < s_acctbal GROUP BY s_suppkey")
def join_inequality(spark, sf_dir):
    """Customers with less on their account than each supplier has."""
    suppliers, customers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), table(spark, sf_dir, "customer")
    return count_smaller(suppliers, "s_acctbal", customers, "c_acctbal", "poorer").select("s_suppkey", "poorer")


@query("""
SELECT k AS o_orderkey, c AS cheaper FROM (
  SELECT k, (count(*) FILTER (k IS NULL) OVER (ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP))::BIGINT AS c
  FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT NULL, l_extendedprice FROM lineitem)
) WHERE k IS NOT NULL
""")
def join_inequality_large(spark, sf_dir):
    """Lines that cost less than each order: both sides grow with the tables."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), table(spark, sf_dir, "lineitem")
    return count_smaller(orders, "o_totalprice", lines, "l_extendedprice", "cheaper").select("o_orderkey", "cheaper")

"""User-defined functions of each kind, with built-in twins in their SQL. They show the surface; built-ins are faster."""

import pandas as pd
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table



@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def udf_scalar(spark, sf_dir):
    twice = F.udf(lambda x: None if x is None else x * 2, "double")
    return table(spark, sf_dir, "orders").select("o_orderkey", twice("o_totalprice").alias("twice"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def udf_vectorized(spark, sf_dir):
    @F.pandas_udf("double")
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", net("l_extendedprice", "l_discount").alias("net"))


@query("SELECT o_orderpriority, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_orderpriority")
def udf_aggregate(spark, sf_dir):
    """A grouped-aggregate function sees a whole group; partial extremes first keep that small."""
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    parts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 16).alias("p")).agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"))
    ends = parts.select("o_orderpriority", F.explode(F.array("a", "b")).alias("x"))
    return ends.groupBy("o_orderpriority").agg(spread("x").alias("s")).select("o_orderpriority", F.round("s", 2).alias("spread"))


@query("SELECT n_nationkey, letter FROM (SELECT n_nationkey, unnest(string_split(n_name, '')) AS letter FROM nation) WHERE letter <> ''")
def udf_table(spark, sf_dir):
    @F.udtf(returnType="letter string")
    class Letters:
        def eval(self, word: str):
            for letter in word or "":
                yield (letter,)

    return table(spark, sf_dir, "nation").lateralJoin(Letters(F.col("n_name").outer())).select("n_nationkey", "letter")


@query("SELECT c_nationkey, count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_nationkey")
def udf_grouped_map(spark, sf_dir):
    """Groups are split in parts, each part is a group to the function, and parts are added up."""

    def told(rows):
        return rows.groupby(["c_nationkey", "p"], as_index=False).agg(n=("c_acctbal", "size"), total=("c_acctbal", "sum"))[["c_nationkey", "n", "total"]]

    parts = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 8).alias("p"), "c_acctbal")
    parts = parts.groupBy("c_nationkey", "p").applyInPandas(told, "c_nationkey int, n long, total double")
    return parts.groupBy("c_nationkey").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 4).alias("mean"))


@query("SELECT p_partkey, p_size + 1 AS size FROM part WHERE p_size > 25")
def udf_partition_map(spark, sf_dir):
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        for b in batches:
            b = b.filter(pc.greater(b.column("p_size"), 25))
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pc.add(b.column("p_size"), 1).cast(pa.int32())], ["p_partkey", "size"])

    return table(spark, sf_dir, "part").select("p_partkey", "p_size").mapInArrow(run, "p_partkey long, size int")


@query("SELECT s_suppkey, round(s_acctbal * 1.1, 4) AS raised FROM supplier")
def udf_sql(spark, sf_dir):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION raised_by(x DOUBLE, share DOUBLE) RETURNS DOUBLE RETURN round(x * (1 + share), 4)")
    told = spark.sql("SELECT s_suppkey, raised_by(s_acctbal, 0.1D) AS raised FROM {supplier}", supplier=table(spark, sf_dir, "supplier"))
    spark.sql("DROP TEMPORARY FUNCTION raised_by")  # its body is in the plan by now
    return told


@query("""
WITH marked AS (SELECT user_id, event_type, event_id, ts, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*)::BIGINT AS n FROM numbered GROUP BY user_id, event_type, s HAVING count(*) > 1
""")
def udf_table_argument(spark, sf_dir):
    """A table function over a partitioned and ordered table: stretches of equal values. Which columns it gives follows from its arguments."""
    from pyspark.sql.types import LongType, StructType
    from pyspark.sql.udtf import AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

    @F.udtf
    class Stretches:
        """Keeps the stretch that goes on, no more, whatever the size of a partition."""

        def __init__(self):
            self.now = None

        @staticmethod
        def analyze(rows, key, column, order, least):
            names = {f.name: f for f in rows.dataType.fields}
            for asked in (key, column, order):
                if asked.value not in names:
                    raise ValueError(f"no column {asked.value}")
            schema = StructType([names[key.value], names[column.value], names[order.value]]).add("n", LongType())
            return AnalyzeResult(
                schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn("ts"), OrderingColumn(order.value)], select=[SelectedColumn(c) for c in (key.value, column.value, order.value, "ts")]
            )

        def eval(self, row, key, column, order, least):
            if self.now and self.now[1] == row[column]:
                self.now[3] += 1
                return
            yield from self.terminate(least)
            self.now, self.least = [row[key], row[column], row[order], 1], least

        def terminate(self, least=None):
            if self.now and self.now[3] >= (least or self.least):
                yield tuple(self.now)

    return Stretches(table(spark, sf_dir, "events").asTable(), F.lit("user_id"), F.lit("event_type"), F.lit("event_id"), F.lit(2))

"""Sketches that are kept: one small table of them for each part of the data, merged by later queries instead of reading the data again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder

#: Count-min: hash functions (a * key + b) % PRIME % WIDTH. An estimate is over by e / WIDTH of all rows at most, with probability 1 - e^-5.
PRIME, WIDTH = (1 << 31) - 1, 2048
HASHES = ((1103515245, 12345), (214013001, 2531011), (1664525001, 1013904223), (69069133, 362437), (134775813, 907633385))
#: Logarithm of the registers of a distinct count: a relative error of 1.04 / sqrt(2^14), 0.8 per cent; and the size parameter of quantiles: ranks are off by about 1.3 per cent.
LOG_REGISTERS, QUANTILE_K = 14, 200
#: Rows of a task that tells distinct keys.
TASK_ROWS = 500_000


def count_min(rows: DataFrame, part: str, key: str) -> DataFrame:
    """part, h, cell and n: counters of each part for an integer key. Null keys aren't counted. At most ``len(HASHES) * WIDTH`` rows a part, whatever its size."""
    x = F.pmod(F.col(key).cast("long"), F.lit(PRIME))
    cells = F.array(*[F.struct(F.lit(i).alias("h"), ((F.lit(a) * x + F.lit(b)) % PRIME % WIDTH).alias("cell")) for i, (a, b) in enumerate(HASHES)])
    # keys are counted first, so that only a part's distinct keys are spread over cells
    counted = rows.filter(F.col(key).isNotNull()).groupBy(part, key).agg(F.count("*").alias("c"))
    return counted.select(part, "c", F.explode(cells).alias("e")).groupBy(part, "e.h", "e.cell").agg(F.sum("c").alias("n"))


def count_min_merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("h", "cell").agg(F.sum("n").alias("n"))


def count_min_estimates(sketch: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``key`` and ``estimate`` for each row of ``keys``: the smallest of its counters, at least the true count. The sketch has a bounded number of rows, so it is broadcast."""
    x = F.pmod(F.col(key).cast("long"), F.lit(PRIME))
    cells = F.array(*[F.struct(F.lit(i).alias("qh"), ((F.lit(a) * x + F.lit(b)) % PRIME % WIDTH).alias("qcell")) for i, (a, b) in enumerate(HASHES)])
    asked = keys.select(key, F.explode(cells).alias("e"))
    found = asked.join(F.broadcast(sketch), (F.col("e.qh") == F.col("h")) & (F.col("e.qcell") == F.col("cell")), "left")
    return found.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def kept_sketches(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Distinct counts of ``key`` and quantiles of ``value`` as binary sketches, a row for each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(key, F.lit(LOG_REGISTERS)).alias("keys"), F.kll_sketch_agg_double(value, F.lit(QUANTILE_K)).alias("quantiles"))


def merged_sketches(sketches: DataFrame, by: str) -> DataFrame:
    return sketches.groupBy(by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def _kept(spark, sf_dir):
    """Sketches of lineitem for each flag and year, written and read back."""
    folder = new_folder(spark, "sketches")
    lines = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    kept_sketches(lines, ["l_returnflag", "y"], "l_partkey", "l_extendedprice").write.partitionBy("y").parquet(folder)
    return spark.read.parquet(folder)


def exact_distinct(rows: DataFrame, by: str, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``by`` and distinct_exact: distinct keys that aren't null. Rows are dealt by group and key to so many tasks that each has about ``task_rows``, whatever the size of the table; nothing is grouped before."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // task_rows))
    # a number given is kept: Spark would put small partitions together, and a task's memory grows with its keys
    dealt = rows.select(by, key).repartition(tasks, by, key).distinct()
    return dealt.groupBy(by).agg(F.count(key).alias("distinct_exact"))


def _exact(spark, sf_dir):
    """Exact distinct counts apart from the sketches: beside them, Spark would keep a sketch for each distinct key."""
    return exact_distinct(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey")


_CELLS = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(HASHES))


@query(f"""
WITH f(h, a, b) AS (VALUES {_CELLS}), s AS (SELECT h, (a::BIGINT * l_partkey + b) % {PRIME} % {WIDTH} AS cell, count(*) AS n FROM lineitem, f GROUP BY 1, 2),
e AS (SELECT p_partkey, min(coalesce(n, 0))::BIGINT AS estimate FROM (SELECT p_partkey, h, (a::BIGINT * p_partkey + b) % {PRIME} % {WIDTH} AS cell FROM part, f) LEFT JOIN s USING (h, cell) GROUP BY 1)
SELECT p_partkey, estimate, coalesce(n, 0)::BIGINT AS exact FROM e LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey
""")
def sketch_count_min(spark, sf_dir):
    """Counts of all parts' lines from count-min sketches kept for each year, beside the exact ones."""
    folder = new_folder(spark, "counters")
    lines = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    count_min(lines, "y", "l_partkey").write.partitionBy("y").parquet(folder)
    told = count_min_estimates(count_min_merged(spark.read.parquet(folder)), table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    exact = lines.groupBy("l_partkey").agg(F.count("*").alias("c"))
    return told.join(exact, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "estimate", F.coalesce("c", F.lit(0)).alias("exact"))


@query()
def sketch_estimates(spark, sf_dir):
    """The estimates as numbers beside exact ones. Quantile sketches draw random numbers, so no SQL gives the same rows; ``group_sketches`` holds them against bounds."""
    told = merged_sketches(_kept(spark, sf_dir), "l_returnflag").select(
        "l_returnflag", "n", F.hll_sketch_estimate("keys").alias("distinct_estimate"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("median_estimate")
    )
    return told.join(_exact(spark, sf_dir), "l_returnflag")


@query("""
SELECT l_returnflag, count(*)::BIGINT AS n, count(DISTINCT l_partkey)::BIGINT AS distinct_exact, true AS distinct_near, true AS median_near FROM lineitem GROUP BY l_returnflag
""")
def group_sketches(spark, sf_dir):
    """Merged sketches held against exact counts: distinct within 4 %, and between 45 and 55 % of all values under the median."""
    told = merged_sketches(_kept(spark, sf_dir), "l_returnflag").select(
        F.col("l_returnflag").alias("flag"), "n", F.hll_sketch_estimate("keys").alias("d"), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5)).alias("m")
    )
    told = told.join(_exact(spark, sf_dir), F.col("flag") == F.col("l_returnflag")).drop("l_returnflag")
    # a row for each flag; without the hint all lines are shuffled by flag before Spark sees how few they are
    under = table(spark, sf_dir, "lineitem").join(F.broadcast(told), F.col("l_returnflag") == F.col("flag")).groupBy("l_returnflag", "n", "distinct_exact", "d").agg(F.count_if(F.col("l_extendedprice") <= F.col("m")).alias("under"))
    return under.select("l_returnflag", "n", "distinct_exact", (F.abs(F.col("d") - F.col("distinct_exact")) <= 0.04 * F.col("distinct_exact")).alias("distinct_near"), F.col("under").between(0.45 * F.col("n"), 0.55 * F.col("n")).alias("median_near"))

"""Exact quantiles of groups of any size: no group is sorted or held whole.

For each group and probability a bracket of values is kept that surely holds the wanted ranks. A round
counts the rows under and inside each bracket and takes a grid of approximate quantiles inside, whose error
is bounded; the grid points next to the rank are the next bracket, a fraction of the rows of the last. When
few rows are left inside, their distinct values are counted and the ranks are read off exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder

#: Grid points of a round, and the accuracy of an approximate quantile: its rank is off by a 1 / ACCURACY of the rows at most, a fraction of a grid step.
GRID, ACCURACY = 100, 2000
#: Brackets with at most so many rows are read off.
LAST = 10_000


def exact_quantiles(rows: DataFrame, by: str, value: str, probabilities: list[float], last: int = LAST) -> DataFrame:
    """``by``, p and q: the interpolated quantiles of ``value`` for each group, as ``percentile`` gives them. Null and NaN values don't count; groups without others give no row.

    Brackets are joined by group; Spark broadcasts them if there are few, by their measured size.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "quantiles")
    v = F.col("v")
    rows = rows.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).filter(v.isNotNull() & ~F.isnan(v))
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    first = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    first = first.select("g", "n", "lo", "hi", ps).withColumn("at", F.col("p") * (F.col("n") - 1))
    first = first.select("g", "p", "at", F.floor("at").alias("k"), "lo", "hi", F.col("n").alias("inside"), F.lit(0).cast("long").alias("below"))
    first.write.parquet(f"{folder}/0")
    brackets, i = spark.read.parquet(f"{folder}/0"), 0

    def within(b):
        return rows.join(b.select(F.col("g").alias("h"), "p", "lo", "hi"), F.col("g").eqNullSafe(F.col("h")) & v.between(F.col("lo"), F.col("hi")))

    while True:
        wide = brackets.filter(F.col("inside") > last)
        if not wide.head(1):
            break
        grid = F.percentile_approx("v", F.array(*[F.lit(j / GRID) for j in range(GRID + 1)]), F.lit(ACCURACY))
        steps = within(wide).groupBy(F.col("g").alias("h"), F.col("p").alias("r")).agg(grid.alias("grid"))
        near = F.floor((F.col("k") - F.col("below")) * GRID / F.greatest(F.col("inside") - 1, F.lit(1))).cast("int")
        cut = wide.join(steps, F.col("g").eqNullSafe(F.col("h")) & (F.col("p") == F.col("r")))
        # two steps to either side: the wanted ranks, a place and the next, lie inside whatever the grid's error
        lo = F.when(near - 2 < 0, F.col("lo")).otherwise(F.get("grid", F.greatest(near - 2, F.lit(0))))
        hi = F.when(near + 4 > GRID, F.col("hi")).otherwise(F.get("grid", F.least(near + 4, F.lit(GRID))))
        cut = cut.select("g", "p", "at", "k", lo.alias("new_lo"), hi.alias("new_hi"), "lo", "hi", F.col("inside").alias("was"), F.col("below").alias("under"))
        cut.write.parquet(f"{folder}/cut-{i}")
        cut = spark.read.parquet(f"{folder}/cut-{i}")
        inside = rows.join(cut.select(F.col("g").alias("h"), F.col("p").alias("r"), "lo", "hi", "new_lo", "new_hi"), F.col("g").eqNullSafe(F.col("h")) & v.between(F.col("lo"), F.col("hi")))
        counts = inside.groupBy("h", "r").agg(F.count_if(v < F.col("new_lo")).alias("less"), F.count_if(v.between(F.col("new_lo"), F.col("new_hi"))).alias("inside"))
        told = cut.join(counts, F.col("g").eqNullSafe(F.col("h")) & (F.col("p") == F.col("r")))
        below = F.col("under") + F.col("less")
        holds = (below <= F.col("k")) & (F.ceil("at") < below + F.col("inside"))  # checked by counts, so that a wrong bracket can't give a wrong quantile
        told = told.select("g", "p", "at", "k", F.when(holds, F.col("new_lo")).otherwise(F.col("lo")).alias("lo"), F.when(holds, F.col("new_hi")).otherwise(F.col("hi")).alias("hi"), F.when(holds, F.col("inside")).otherwise(F.col("was")).alias("inside"), F.when(holds, below).otherwise(F.col("under")).alias("below"), (holds & (F.col("inside") < F.col("was"))).alias("shrunk"))
        i += 1
        told.write.parquet(f"{folder}/told-{i}")
        told = spark.read.parquet(f"{folder}/told-{i}")
        moved = told.filter("shrunk").head(1)
        # a bracket that doesn't shrink holds few distinct values, repeated often
        stuck = told.filter("NOT shrunk").drop("shrunk").withColumn("inside", F.lit(0).cast("long"))
        parts = [brackets.filter(F.col("inside") <= last), told.filter("shrunk").drop("shrunk"), stuck]
        reduce(DataFrame.unionByName, parts).write.parquet(f"{folder}/{i}")
        brackets = spark.read.parquet(f"{folder}/{i}")
        if not moved:
            break
    values = within(brackets).groupBy("g", "p", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("g", "p").orderBy("v"))
    values = values.select(F.col("g").alias("h"), F.col("p").alias("r"), "v", "c", upto.alias("upto"))
    read = brackets.join(values, F.col("g").eqNullSafe(F.col("h")) & (F.col("p") == F.col("r")))
    end = F.col("below") + F.col("upto")
    holds = lambda k: (k >= end - F.col("c")) & (k < end)
    read = read.groupBy("g", "p", "at", "k").agg(F.max(F.when(holds(F.col("k")), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil("at")), F.col("v"))).alias("b"))
    return read.select(F.col("g").alias(by), "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("k"))).alias("q"))


@query("""
SELECT l_returnflag, p::DOUBLE AS p, round(q, 4) AS q FROM (SELECT l_returnflag, unnest([0.0, 0.25, 0.5, 0.9, 0.999]) AS p,
  unnest(quantile_cont(l_extendedprice, [0.0, 0.25, 0.5, 0.9, 0.999])) AS q FROM lineitem GROUP BY l_returnflag)
""")
def group_exact_quantiles(spark, sf_dir):
    """Exact quantiles by narrowing brackets."""
    told = exact_quantiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", [0.0, 0.25, 0.5, 0.9, 0.999])
    return told.select("l_returnflag", "p", F.round("q", 4).alias("q"))

"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node but the roots of edges(a, b); a root is the smallest node of its component.

    Large-star and small-star steps in turn, until nothing changes. Each step is an aggregation
    with partial sums and a join that adaptive execution can split, so a node with very many
    neighbours isn't gathered in one place. Every round is a written table.
    """
    own = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, last, k = scratch.save(own, f"{name}-0"), None, 0
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("low")).select("c", F.least("c", "low").alias("low"))
        large = both.join(low, F.col("a") == F.col("c")).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("c"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        k += 1
        after = scratch.save(small.filter(F.col("a") != F.col("b")).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        told = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        now = after
        if told == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = told

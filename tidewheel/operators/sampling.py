"""Samples that are a function of keys and a seed alone: partitions, order and the engine don't change them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table


def key_hash(key: str, seed: int) -> Column:
    """32 hexadecimal digits, evenly spread; compared as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def threshold(share: float) -> str:
    """Hashes under this text are so large a share of all."""
    return f"{min(int(share * 16**8), 16**8 - 1):08x}" if share < 1 else "g"


def bernoulli(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Each row with a key stays with probability ``share``; rows of a key stay or go together. A filter: nothing is shuffled."""
    return rows.filter(F.col(key).isNotNull() & (key_hash(key, seed) < threshold(share)))


def exact_per_stratum(rows: DataFrame, stratum: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """The k rows of each stratum (null is one) with the smallest hashes, then keys; all, if fewer. Keys are to be unique; rows without one stay out.

    Counts of the strata give each a share that surely holds k hashes but for strata told short by a count, which keep
    all their rows: so about k rows of a stratum are shuffled, and no stratum is sorted whole.
    """
    h = key_hash(key, seed)
    rows = rows.filter(F.col(key).isNotNull())
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    share = (F.lit(k) + 8 * F.sqrt(F.lit(float(k))) + 16) / F.col("_n")
    sizes = sizes.withColumn("_most", F.when(share >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(F.floor(F.least(share, F.lit(1.0)) * 16**8).cast("long"))), 8, "0")))
    on = F.col(stratum).eqNullSafe(F.col("_s"))
    near = rows.join(sizes, on).filter(h < F.col("_most"))
    found = near.groupBy("_s").agg(F.count("*").alias("_got"))
    short = sizes.join(found.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").filter((F.coalesce("_got", F.lit(0)) < k) & (F.col("_n") > F.coalesce("_got", F.lit(0))))
    if short.head(1):  # so rare that it costs nothing: 8 standard deviations
        near = near.join(short.select(F.col("_s").alias("_u")), F.col("_s").eqNullSafe(F.col("_u")), "left_anti").unionByName(rows.join(short.select("_s", "_n", "_most"), on))
    first = F.row_number().over(Window.partitionBy("_s").orderBy(h, key))
    return near.withColumn("_rank", first).filter(F.col("_rank") <= k).drop("_s", "_n", "_most", "_rank")


@query("SELECT doc_id, lang FROM documents WHERE substr(md5('42:' || doc_id), 1, 8) < '19999999'")
def sample_bernoulli(spark, sf_dir):
    """A tenth of the documents."""
    return bernoulli(table(spark, sf_dir, "documents"), "doc_id", 0.1, 42).select("doc_id", "lang")


@query("""
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents WHERE doc_id IS NOT NULL) WHERE r <= 20
""")
def sample_per_stratum(spark, sf_dir):
    """Twenty documents of each source."""
    return exact_per_stratum(table(spark, sf_dir, "documents"), "source", "doc_id", 20, 7).select("doc_id", "source")

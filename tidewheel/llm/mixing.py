r"""Mixing sources to target weights.

Targets come from water-filling: sources share a budget by weight, none above a multiple of its
size. Within a source, whole epochs come first; the rest goes to documents in the order of
Efraimidis-Spirakis keys, -ln(u) / quality, smallest first, until the prefix sum of sizes meets
the budget. The document at the edge gives a part, so that a source meets its target exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, read_table, small_side

#: Quantiles of keys, from which each source's buckets are laid out.
CUTS = 32
SYMBOLS = "|#$%&*!<>{}[]\\/@~^=+_"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of characters that aren't symbols."""
    n = F.length(text)
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.05), F.length(F.translate(text, SYMBOLS, "")) / n)), F.lit(0.05))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the id and the seed only, so reruns agree."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, budget_share: float, cycle: tuple[float, ...], most: float) -> DataFrame:
    """sizes(source, source_size, rows) with weight and target. One row per source is all that meets here."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("k", (F.row_number().over(by_name) - 1) % len(cycle)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), F.col("k") + 1)
    )
    cap, every = F.col("source_size") * most, Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * budget_share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return filled.select(F.col("source").alias("s"), "source_size", "rows", target.alias("target"))


def mix(
    docs: DataFrame,
    budget_share: float = 1.5,
    cycle: tuple[float, ...] = (3.0, 1.0, 2.0),
    most: float = 2.0,
    seed: int = 17,
    bucket_rows: int = 10_000,
    quality_weight: Column | None = None,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for every row of docs(doc_id, text, source).

    Nulls: a null text has size 0 and takes nothing, a null source is one source and comes last, a
    null doc_id is an id like any other. Rows with equal keys go by doc_id, then size; rows equal
    in both may swap, which leaves the same result. An empty table gives an empty result.
    Other columns aren't read, whatever their names; a text of any length gives its size only. Only
    ids and sizes are sorted. Within a source, keys are dealt to buckets by a monotone map that
    follows their quantiles, so a source with most of the rows is sorted in many tasks whatever its
    weights, and sums of buckets give the offsets.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    weight = quality(F.col("text")) if quality_weight is None else quality_weight
    meta = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"))
    meta = scratch.save(meta, "meta")
    spread = F.col("key") / (1 + F.col("key"))
    cuts = F.percentile_approx(spread, [i / CUTS for i in range(CUTS + 1)], 10 * CUTS).alias("cuts")
    sizes = meta.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), cuts)
    sizes = scratch.save(sizes, "sizes")
    targets = source_targets(sizes.drop("cuts"), budget_share, cycle, most)
    targets = targets.join(sizes.select(F.col("source").alias("_source"), "cuts"), F.col("s").eqNullSafe(F.col("_source"))).drop("_source")
    targets = scratch.save(targets, "targets")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    dealt = meta.join(small_side(targets, 80 + 8 * CUTS, F.octet_length("s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the quantile below the key, and how far it is from there to the next: rows of a source come in equal parts, nearly
    low = F.greatest(F.size(F.filter("cuts", lambda c: c <= spread)), F.lit(1))
    near = lambda i: F.get("cuts", F.least(i, F.lit(CUTS)))
    part = (spread - near(low - 1)) / F.when(near(low) > near(low - 1), near(low) - near(low - 1))
    share = (low - 1 + F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.coalesce(part, F.lit(0.0))))) / (CUTS + 1)
    dealt = dealt.withColumn("bucket", F.floor(share * F.ceil(F.col("rows") / bucket_rows)).cast("long")).drop("cuts")
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(order), F.lit(0)).alias("offset"))
    sums = scratch.save(sums, "offsets")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("prefix", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    ranked = ranked.join(small_side(sums, 40, F.octet_length("s")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("prefix")))
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "source")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source")


OP5_SQL = r"""
WITH meta AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substring(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / coalesce(CASE WHEN length(text) > 0 THEN greatest(0.05, length(translate(text, '|#$%&*!<>{}[]\/@~^=+_', ''))::DOUBLE / length(text)) END, 0.05) AS key
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM meta GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM sizes WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= cap / w THEN level END) OVER () * w, cap)) AS target FROM levels
), epochs AS (
  SELECT *, floor(target + 0.5)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS e FROM targets
), ranked AS (
  SELECT m.doc_id, m.size, t.source_size, t.target, t.e, t.budget - t.e * t.source_size AS rest,
    coalesce(sum(m.size) OVER (PARTITION BY m.source ORDER BY m.key, m.doc_id, m.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM meta m JOIN epochs t ON m.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (e * size + greatest(0, least(size, rest - prefix)))::BIGINT AS taken FROM ranked
"""

"""How well a score tells labels apart, from one table of counts by score: no sort of all rows, no pair of rows.

Scores are whole numbers 0 to MOST, so a group has at most MOST + 1 rows after the first grouping,
whose partial counts are made before anything is shuffled; running totals are taken over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table

MOST = 10_000


def counted(rows: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """For each group and score: pos and neg with that score, tp and fp with it or a higher one, all_pos and all_neg of the group.

    A label is 1 or 0; rows with another, or with a null score or one outside 0 to MOST, don't count. A null group is a group.
    """
    rows = rows.select(F.col(by).alias("g"), F.col(score).cast("int").alias("s"), F.col(label).cast("int").alias("l")).filter(F.col("l").isin(0, 1) & F.col("s").between(0, MOST))
    counts = rows.groupBy("g", "s").agg(F.sum("l").alias("pos"), F.sum(1 - F.col("l")).alias("neg"))
    down, whole = Window.partitionBy("g").orderBy(F.desc("s")), Window.partitionBy("g")
    return counts.select("*", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("all_pos"), F.sum("neg").over(whole).alias("all_neg"))


def metrics(counts: DataFrame) -> DataFrame:
    """Of each group of ``counted``: g, n, positives, auc, average_precision, best_f1, best_score and accuracy at best_score.

    auc is the share of pairs of a 1 and a 0 in which the 1 has the higher score, ties for one half; null where
    a group has one label only. average_precision and best_f1 are null without a 1. best_score is the least
    score to call 1 for the best F1, the highest of several as good.
    """
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    f1 = F.when(F.col("all_pos") > 0, 2 * tp / (tp + fp + F.col("all_pos")))
    lower = F.col("all_neg") - fp
    right = (F.col("tp") + F.col("all_neg") - F.col("fp")).cast("double")
    told = counts.select("g", "s", "pos", "neg", "all_pos", "all_neg", (pos * (lower + neg / 2)).alias("won"), (pos * tp / (tp + fp)).alias("precise"), f1.alias("f1"), right.alias("right"))
    best = F.max(F.struct("f1", "s", "right"))
    n = F.first("all_pos") + F.first("all_neg")
    found = told.groupBy("g").agg(
        n.alias("n"), F.first("all_pos").alias("positives"), F.first("all_neg").alias("negatives"), F.sum("won").alias("won"), F.sum("precise").alias("precise"), best.alias("best")
    )
    some = F.col("positives") > 0
    return found.select(
        "g", "n", "positives", F.when(some & (F.col("negatives") > 0), F.col("won") / F.col("positives") / F.col("negatives")).alias("auc"),
        F.when(some, F.col("precise") / F.col("positives")).alias("average_precision"), F.col("best.f1").alias("best_f1"),
        F.when(some, F.col("best.s")).alias("best_score"), F.when(some, F.col("best.right") / F.col("n")).alias("accuracy"),
    )


def plain_share(text: Column) -> Column:
    """Letters a to z and spaces in a text, in ten-thousandths of its characters; 0 for an empty or null one."""
    # runs of letters are taken out in one step each, and what is left is counted: three in four characters of prose are letters
    letters = (F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z ]++", ""))).cast("long")
    return F.coalesce(F.when(F.length(text) > 0, F.floor(letters * MOST / F.length(text))), F.lit(0)).cast("int")


def _scored(spark, sf_dir) -> DataFrame:
    # inline_outer works a score out once a row: filters on a projected score repeat its expression
    told = F.inline_outer(F.array(F.struct(plain_share(F.col("text")).alias("score"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", told)
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


_COUNTED_SQL = r"""
s AS (SELECT source, quality AS l, CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^A-Za-z ]', '', 'g'))::BIGINT * 10000 // length(text) ELSE 0 END::INTEGER AS s
  FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
c AS (SELECT source, s, sum(l)::BIGINT AS pos, sum(1 - l)::BIGINT AS neg FROM s GROUP BY source, s),
r AS (SELECT *, (sum(pos) OVER (PARTITION BY source ORDER BY s DESC))::BIGINT AS tp, (sum(neg) OVER (PARTITION BY source ORDER BY s DESC))::BIGINT AS fp,
  (sum(pos) OVER (PARTITION BY source))::BIGINT AS ap, (sum(neg) OVER (PARTITION BY source))::BIGINT AS an FROM c)
"""


@query(f"""
WITH {_COUNTED_SQL},
pairs AS (SELECT a.source, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc FROM s a JOIN s b ON a.source = b.source AND a.l = 1 AND b.l = 0 GROUP BY a.source),
m AS (SELECT source, any_value(ap + an) AS n, any_value(ap) AS positives, sum(pos * tp / (tp + fp)::DOUBLE) / any_value(ap) AS average_precision,
  max(CASE WHEN ap > 0 THEN 2 * tp / (tp + fp + ap)::DOUBLE END) AS best_f1 FROM r GROUP BY source)
SELECT source, n, positives, round(auc, 6) AS auc, round(CASE WHEN positives > 0 THEN average_precision END, 6) AS average_precision, round(best_f1, 6) AS best_f1
FROM m LEFT JOIN pairs USING (source)
""")
def score_metrics(spark, sf_dir):
    """How well the share of plain letters tells quality, by source."""
    found = metrics(counted(_scored(spark, sf_dir), "source", "score", "quality"))
    return found.select(F.col("g").alias("source"), "n", "positives", *[F.round(c, 6).alias(c) for c in ("auc", "average_precision", "best_f1")])


@query(f"""
WITH {_COUNTED_SQL}
SELECT source, s AS score, tp, fp, round(tp / (tp + fp)::DOUBLE, 6) AS precision_at, round(CASE WHEN ap > 0 THEN tp / ap::DOUBLE END, 6) AS recall_at FROM r
""")
def score_curve(spark, sf_dir):
    """Precision and recall at each score that a source has, when documents with it or a higher one are called good."""
    rows = counted(_scored(spark, sf_dir), "source", "score", "quality")
    recall = F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos"))
    return rows.select(F.col("g").alias("source"), F.col("s").alias("score"), "tp", "fp", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision_at"), F.round(recall, 6).alias("recall_at"))

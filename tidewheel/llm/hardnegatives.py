"""Hard-negative mining with bit-sliced integer products.

Vectors are integers. The components of a block of rows are sliced in bit-planes; planes are multiplied
with the anchors from the most significant one on. After each plane the part of a score that is still
missing lies in an interval that the anchor's components bound, and an anchor and a row whose scores can
no longer qualify are dropped. Few pairs come to the last plane, and those have their exact score.

Anchors come in chunks of a bounded size and are broadcast; rows stay where they are. A first search
gives each anchor its best rows of its own label, a second one the rows of other labels that score
within a window under each of these. A task keeps the best rows of each anchor (and positive) only, and
its last of them tightens what later rows must reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES, Scratch, partitions, read_table, small_side

#: Rows and anchors whose products are made at once, and pairs that are followed one by one at once.
ROWS, ANCHORS, PAIRS = 1024, 512, 1 << 14
#: Planes are multiplied for all pairs of a block until at most this share of them is left.
SPARSE = 1 / 16
#: Beyond all scores.
LOWEST, HIGHEST = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Settings:
    """``low`` and ``high`` are per cents of a positive's score; ``first_rows`` bounds the rows of the first pass, roughly."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    first_rows: int = 4096


def sliced_products(x: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, open_pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs of rows of ``x`` and ``q`` among ``open_pairs`` whose integer inner product is from low to high of the anchor.

    Sums are exact: in double precision where all of them are integers under 2^53, else in 64-bit integers.
    """
    bits = int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length() + 1  # two's complement
    largest = float(1 << bits) * np.abs(q).max(initial=0) * x.shape[1]
    kind = np.float64 if largest < 2**52 else np.int64
    q = q.astype(kind)
    more, less = q.clip(min=0).sum(axis=1), q.clip(max=0).sum(axis=1)
    part, alive, at = np.zeros((len(x), len(q)), dtype=kind), open_pairs, bits
    while at and alive.mean() > SPARSE:
        at -= 1
        weight = kind(1 << at) * (-1 if at == bits - 1 else 1)  # the first plane holds the sign
        part += weight * ((x >> at & 1).astype(kind) @ q.T)
        rest = kind((1 << at) - 1)
        alive = alive & (part + rest * more >= low) & (part + rest * less <= high)
    rows, anchors = np.nonzero(alive)
    out = []
    for start in range(0, len(rows), PAIRS):
        i, j = rows[start : start + PAIRS], anchors[start : start + PAIRS]
        score = part[i, j]
        for k in range(at - 1, -1, -1):
            weight = kind(1 << k) * (-1 if k == bits - 1 else 1)
            score = score + weight * np.einsum("ij,ij->i", (x[i] >> k & 1).astype(kind), q[j])
            rest = kind((1 << k) - 1)
            left = (score + rest * more[j] >= low[j]) & (score + rest * less[j] <= high[j])
            i, j, score = i[left], j[left], score[left]
        out.append((i, j, score.astype(np.int64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


class Best:
    """The first k rows of each slot, by score, then id, and the score that a further row must reach."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.held = [np.zeros(0, np.int64)] * 3

    def add(self, slot: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, vec_id, score = (np.concatenate(v) for v in zip(self.held, (slot, vec_id, score), strict=True))
        order = np.lexsort((vec_id, -score, slot))
        slot, vec_id, score = slot[order], vec_id[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        full = place == self.k - 1
        self.floor[slot[full]] = np.maximum(self.floor[slot[full]], score[full])
        self.held = [v[place < self.k] for v in (slot, vec_id, score)]


def _search(rows: DataFrame, shared) -> DataFrame:
    """slot, vec_id and score of each task's best rows.

    Shared are the ids, labels and vectors of a chunk of anchors, the best k to keep, and the slots: each has an
    anchor (in order), the lowest and highest score it takes, and whether it takes its anchor's own label or others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, k, own_label, slot_anchor, low, high = shared.value
        best = Best(k, low)
        first = np.searchsorted(slot_anchor, np.arange(len(ids) + 1))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                row_id, row_label = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = b.column(2).flatten().to_numpy().reshape(len(row_id), vectors.shape[1])
                for c in range(0, len(ids), ANCHORS):
                    part = slice(c, min(c + ANCHORS, len(ids)))
                    slots = slice(first[part.start], first[part.stop])
                    if slots.start == slots.stop:
                        continue
                    # an anchor's pairs are followed while any of its slots may take them; anchors without slots take none
                    least, most = np.full(part.stop - c, HIGHEST), np.full(part.stop - c, LOWEST)
                    np.minimum.at(least, slot_anchor[slots] - c, np.maximum(low, best.floor)[slots])
                    np.maximum.at(most, slot_anchor[slots] - c, high[slots])
                    same = row_label[:, None] == labels[None, part]
                    pairs = (same == own_label) & (row_id[:, None] != ids[None, part])
                    i, j, score = sliced_products(x, vectors[part], least, most, pairs)
                    # a pair goes to those of its anchor's slots that take its score
                    n = first[j + c + 1] - first[j + c]
                    pair = np.repeat(np.arange(len(j)), n)
                    slot = first[j + c][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                    fits = (score[pair] >= np.maximum(low, best.floor)[slot]) & (score[pair] <= high[slot])
                    pair, slot = pair[fits], slot[fits]
                    best.add(slot, row_id[i[pair]], score[pair])
        slot, vec_id, score = best.held
        for at in range(0, len(slot), 1 << 16):
            z = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(v[z]) for v in (slot, vec_id, score)], ["slot", "vec_id", "score"])

    return rows.mapInArrow(run, "slot long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def usable(vectors: DataFrame, vec_id: str, label: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, label, v (scaled integers) and n (components) of rows that take part; a row for each id.

    A component c must have c * c * n < 2^60, so that scores and their bounds fit in a long.
    """
    v = F.col(embedding)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale * F.sqrt(F.size(v)) < 2.0**30))
    kept = vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & plain)
    whole = F.transform(v, lambda x: F.floor(scale * x.cast("double")))
    rows = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.cast("array<long>").alias("v"))
    # dealt by number, so that adaptive execution doesn't put a few compute-heavy megabytes in one task; the aggregation needs no other exchange
    rows = rows.repartition(partitions(vectors.sparkSession), "vec_id")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v", F.size("r.v").alias("n"))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, s: Settings = Settings(), vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor and positive.

    An anchor's positives are its best other rows of its label among all ``vectors``; the negatives of a
    positive are the best rows of other labels with ``low`` to ``high`` per cent of the positive's score.
    Ties go to the smaller id.

    Rows with a null id, label, vector or component, a NaN or infinite component, one too large for
    products that fit in a long, or another length than most usable rows (the shortest of equally common ones)
    take no part. Rows that share an id count once: the one of the smallest label, then components. Anchors
    without a positive, and positives without a negative, give no row; nor do empty tables. Other columns
    are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.save(usable(vectors, vec_id, label, embedding, s.scale), "rows")
    common = rows.groupBy("n").count().orderBy(F.desc("count"), "n").head(1)
    dim = common[0]["n"] if common else 0
    rows = rows.filter(F.col("n") == dim).select("vec_id", "label", "v")
    asked = rows.join(anchors.select(F.col(vec_id).cast("long").alias("asked")).distinct(), F.col("vec_id") == F.col("asked"), "left_semi")
    asked = scratch.save(asked, "anchors")
    n_anchors, n_rows = asked.count(), rows.count()
    chunks, part = max(1, -(-n_anchors * (8 * dim + 24 * (s.positives + 1)) // BROADCAST_BYTES)), max(1, n_rows // s.first_rows)
    some = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(part)) == 0)

    def search(mine, k: int, own_label: bool, slot_anchor: np.ndarray, low: np.ndarray, high: np.ndarray, name: str) -> DataFrame:
        """Best rows of each slot. The first pass, over a part of the rows, only raises what rows of the second, over all, must reach."""
        if part > 1:
            with_some = _first(_search(some, spark.sparkContext.broadcast((*mine, k, own_label, slot_anchor, low, high))), k)
            last = with_some.filter(F.col("rank") == k).select("slot", "score").toArrow()
            low = low.copy()
            low[last.column("slot").to_numpy()] = last.column("score").to_numpy()
        return scratch.save(_first(_search(rows, spark.sparkContext.broadcast((*mine, k, own_label, slot_anchor, low, high))), k), name)

    out = None
    for c in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").toArrow()
        if not own.num_rows:
            continue
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        mine = ids, labels, own.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        every = np.arange(len(ids))
        positive = search(mine, s.positives, True, every, np.full(len(ids), LOWEST), np.full(len(ids), HIGHEST), f"positives-{c}")
        told = positive.orderBy("slot", "rank").select("slot", "vec_id", "score").toArrow()
        slot, positive_id, score = (told.column(n).to_numpy() for n in ("slot", "vec_id", "score"))
        # score <= n <= score in per cent, as whole numbers; Python's integers don't overflow
        low = np.array([-(-s.low * int(x) // 100) for x in score], dtype=np.int64)
        high = np.array([s.high * int(x) // 100 for x in score], dtype=np.int64)
        found = search(mine, s.negatives, False, slot, low, high, f"negatives-{c}")
        pairs = pa.table({"pair": np.arange(len(slot)), "anchor_id": ids[slot], "positive_id": positive_id, "positive_score": score})
        pairs = scratch.save(spark.createDataFrame(pairs), f"pairs-{c}")
        told = found.join(small_side(pairs, 32), F.col("slot") == F.col("pair"))
        told = told.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out = told if out is None else out.unionAll(told)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return out if out is not None else spark.createDataFrame([], empty)


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's labels: those of ids divisible by 7 are one further, modulo 10."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = relabelled(read_table(spark, sf_dir, "embeddings"))
    return hard_negatives(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP12_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""

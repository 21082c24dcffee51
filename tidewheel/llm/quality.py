"""A quality classifier: logistic regression on hashed word n-grams, learned with FTRL-proximal updates.

Tokens are runs of letters, of digits or of other signs within a word. Features are hashed n-grams
of tokens (1 and 2, in lower case) and of token shapes (1 to 3: case, length, and whether a word
repeats the one before). Their values are counts divided by the number of tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table, small_batches, trimmed
from .textblocks import _LOWER, _SPACE, blocks, mix, ngrams, run_hashes, text_array

_KIND = np.full(256, 3, dtype=np.int8)  # 0 space, 1 letter or part of a longer character, 2 digit, 3 other
_KIND[_SPACE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that are learned from: those with the smallest hashes of their ids."""

    bits: int = 18
    max_rows: int = 8_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 8.0


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(offsets of rows in tokens, hashed n-grams by their first token, which of them lie within one row)."""
    kind = _KIND[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    told = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
    start, end = start[told], end[told]
    first = np.searchsorted(start, offsets)
    token = run_hashes(_LOWER[data], start, end)
    upper = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_UPPER[data], out=upper[1:])
    kinds, size = kind[start].astype(np.int64), end - start
    n_upper = upper[end] - upper[start]
    case = np.where(n_upper == 0, 0, np.where((n_upper == size) & (size > 1), 2, 1))
    same = np.zeros(len(token), dtype=np.int64)
    word = np.flatnonzero(kinds == 1)
    same[word[1:]] = token[word[1:]] == token[word[:-1]]
    code = kinds | case << 3 | same << 6 | np.minimum(size, 31) // 4 << 8
    shape = mix(code.astype(np.uint64) + np.uint64(1 << 32))
    shape = np.where(kinds == 3, mix(token + np.uint64(7)), shape)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    grams, inside = [], []
    for values, n, salt in ((token, 1, 1), (token, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
        h = ngrams(values, n, salt)
        grams.append((h >> np.uint64(64 - bits)).astype(np.int64))
        inside.append(row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, dtype=bool))
    return first, grams, inside


def examples(texts: pa.Array, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, values) of each text, for learning."""
    for _, _, data, offsets in blocks(text_array(texts)):
        first, grams, inside = features(data, offsets, s.bits)
        for a, b in zip(first[:-1], first[1:], strict=True):
            own = [g[a:b][i[a:b]] for g, i in zip(grams, inside, strict=True)]
            at, count = np.unique(np.concatenate(own), return_counts=True)
            yield at.astype(np.int32), (count * (s.scale / max(1, b - a))).astype(np.float32)


def scores(texts: pa.Array, weights: np.ndarray, s: Settings) -> np.ndarray:
    """Scores of texts as sparse dot products; the last weight is the bias."""
    out = np.zeros(len(texts))
    for start, end, data, offsets in blocks(text_array(texts)):
        first, grams, inside = features(data, offsets, s.bits)
        sums = np.zeros(first[-1] + 1)
        for g, i in zip(grams, inside, strict=True):
            sums[1 : len(g) + 1] += np.where(i, weights[g], 0.0)
        sums = np.cumsum(sums)
        dot = (sums[first[1:]] - sums[first[:-1]]) * s.scale / np.maximum(1, np.diff(first))
        out[start:end] = 1 / (1 + np.exp(-np.clip(dot + weights[-1], -35, 35)))
    return out


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights by FTRL-proximal over rows of (features, values, label), in the given order, some epochs."""
    z, n = np.zeros((1 << s.bits) + 1), np.zeros((1 << s.bits) + 1)

    def weight(at):
        zi = z[at]
        return np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    bias = np.int32(1 << s.bits)
    rows = [(np.append(at, bias), np.append(x, np.float32(1)).astype(np.float64), y) for at, x, y in rows]
    for _ in range(s.epochs):
        for at, x, y in rows:
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / s.alpha * w
    return weight(np.arange(len(z))).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Weights from docs(doc_id, text) with labels(doc_id, quality) that aren't held out.

    At most ``max_rows`` documents with a label are used, so that their ids can be broadcast and one
    task can learn from them. Of several labels of an id the smallest counts, of several texts of an
    id the one with the smallest hash; null ids and labels are left out. Without any row the weights
    are 0 and every score is 0.5. The order of the input doesn't matter.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.max_rows)
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    some = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 128):
                part = b.slice(start, 128)
                own = list(examples(part.column(2), s))
                at, x = (pa.array([e[k].tobytes() for e in own], pa.binary()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), at, x], ["doc_id", "label", "at", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for y, at, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                rows.append((np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), y))
        yield pa.RecordBatch.from_arrays([pa.array([learn(rows, s).tobytes()], pa.binary())], ["weights"])

    seen = some.select(F.col("doc_id").cast("long"), "label", "t.text").mapInArrow(trimmed(extract), "doc_id long, label int, at binary, x binary")
    # one task by contract of max_rows: a row for each id
    one = seen.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = one.mapInArrow(trimmed(fit), "weights binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else np.zeros((1 << s.bits) + 1, np.float32)


def scorer(spark: SparkSession, weights: np.ndarray, s: Settings = Settings()):
    """A function of a text column to its score: only the text goes to Python, other columns of the row stay in the JVM."""
    shared = small_batches(spark).sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(scores(texts, shared.value, s), pa.float64())

    return F.arrow_udf(trimmed(run), "double")


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs and ``score``, from the text alone; a null text counts as empty and gets the bias.

    Other columns aren't read, whatever their names; ``keep`` may not hold ``score``. Texts are taken in
    blocks, and a longer text is a block of its own. Repeated rows give repeated rows.
    """
    return docs.select(*[docs[c] for c in keep], scorer(docs.sparkSession, weights, s)(docs["text"].cast("string")).alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. Repeated rows give repeated rows; an empty table gives none."""
    docs = read_table(spark, sf_dir, "documents")
    weights = train(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

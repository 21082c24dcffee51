"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its inner s-mers is that of the
first or the last one. That depends on the k-mer alone, so an edit changes anchors only where it
touches them. A fingerprint keeps the anchors with the smallest hashes, each with its place in
the text; two fingerprints are alike as far as their smallest anchors agree in hash and in place,
places being compared after the shift that most common anchors vote for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import partitions, read_table
from .textblocks import mix

K, S, KEPT = 24, 8, 64
#: Anchors match if their places, less the common shift, differ by at most so many code points and a 64th of the longer text.
NEAR = 64
MOST_RUNS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(values: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of each run of n values, by doubling."""
    out, size = None, 1
    run, at = values, 0
    while True:
        if n & size:
            if out is None:
                out, at = run, size
            else:
                m = len(values) - at - size + 1
                out = out[:m] + run[at : at + m] * _power(at)
                at += size
        if at == n:
            return mix(out[: len(values) - n + 1])
        run = run[: len(run) - size] + run[size:] * _power(size)
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 2**64))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each run of n values."""
    run, size = values, 1
    while 2 * size <= n:
        run = np.minimum(run[: len(run) - size], run[size:])
        size *= 2
    m = len(values) - n + 1
    return np.minimum(run[:m], run[n - size : n - size + m])


def anchors(codes: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of an array of code points. A text under k code points is one anchor."""
    if len(codes) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    spread = mix(codes.astype(np.uint64) + np.uint64(1))
    if len(codes) < k:
        return np.zeros(1, dtype=np.int64), _windows(spread, len(codes))
    inner = _windows(spread, s)
    low = _least(inner, k - s + 1)
    at = np.flatnonzero((low == inner[: len(low)]) | (low == inner[k - s :]))
    return at, _windows(spread, k)[at]


def fingerprint(codes: np.ndarray, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes of 32 bits in rising order, places, length); of equal hashes the first place counts."""
    at, h = anchors(codes)
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * kept:
        # only hashes up to the (8 * kept)-th smallest can matter unless they repeat a lot
        low = np.partition(h, 8 * kept)[8 * kept]
        some = h <= low
        if len(np.unique(h[some])) >= kept:
            at, h = at[some], h[some]
    h, first = np.unique(h, return_index=True)
    return h[:kept], at[first[:kept]], len(codes)


def told(mark: tuple[np.ndarray, np.ndarray, int]) -> str:
    """As text: length, then hash and place of each anchor, in hexadecimal."""
    h, at, n = mark
    return f"{n:x}:" + "".join(f"{x:08x}{y:x}." for x, y in zip(h.tolist(), at.tolist(), strict=True))


def shift(moved: np.ndarray, slack: int) -> int:
    """Of the differences ``moved``, the one that has most of them within ``slack`` of itself; of several such, that nearest to 0, then the smaller."""
    moved = np.sort(moved)
    votes = np.searchsorted(moved, moved + slack, side="right") - np.searchsorted(moved, moved - slack, side="left")
    best = moved[votes == votes.max()]
    return int(best[np.lexsort((best, np.abs(best)))[0]])


def likeness(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], kept: int = KEPT) -> float:
    """Share of the smallest anchors of both together that both have, at near places but for one shift of all; 1 for two texts without anchors.

    The shift is that of the text's common anchors: words put before a text move all of its anchors
    alike and cost only what they add. Anchors that moved against the others don't count.
    """
    if len(a[0]) == 0 or len(b[0]) == 0:
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:kept]
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(both) == 0:
        return 0.0
    moved, slack = a[1][i] - b[1][j], NEAR + max(a[2], b[2]) // 64
    near = np.abs(moved - shift(moved, slack)) <= slack
    return float(np.isin(both[near], union, assume_unique=True).sum()) / len(union)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def with_next(docs: DataFrame, target_rows: int = 4_000) -> DataFrame:
    """docs(doc_id, text) dealt to runs of neighbours in descending doc_id: run, ghost, doc_id, text.

    Each run ends with a ghost: a copy of the row that comes next, so that a run needs no other.
    Bounds of runs are quantiles of doc_id; only the bounds, one for some thousands of rows, are on
    the driver. Order: doc_id descending, null last; then text, null as empty.
    """
    ids = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    n = ids.count()
    # more rows than that give longer runs: a run is streamed from a sort that can spill, so none has to fit in memory
    runs = min(MOST_RUNS, max(partitions(docs.sparkSession), -(-n // target_rows)))
    shares = [i / runs for i in range(1, runs)]
    bounds = sorted({int(x) for x in ids.approxQuantile("doc_id", shares, 1 / (4 * runs))}) if shares and n else []
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # a row's run: how many bounds are above its id, found by halving; nulls come last
    row_run = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(_above(bounds, F.col("doc_id"), 0, len(bounds)))
    dealt = rows.withColumn("run", row_run.cast("int"))
    firsts = dealt.select("run", "doc_id").groupBy("run").agg(F.max("doc_id").alias("id")).orderBy("run").collect()
    if not firsts:
        return dealt.select("run", F.lit(False).alias("ghost"), "doc_id", "text")
    # the first id of each run goes to the run before it as well, that of the first run to the last
    before = {r["run"]: firsts[i - 1]["run"] for i, r in enumerate(firsts)}
    heads = docs.sparkSession.createDataFrame([(r["run"], r["id"], before[r["run"]]) for r in firsts], "head_run int, head_id long, to_run int")
    heads = F.broadcast(heads)  # a row for each run
    ghosts = dealt.join(heads, (F.col("run") == F.col("head_run")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    ghosts = ghosts.select(F.col("to_run").alias("run"), F.lit(True).alias("ghost"), "doc_id", "text")
    return dealt.select("run", F.lit(False).alias("ghost"), "doc_id", "text").unionAll(ghosts)


def _above(bounds: list[int], x, low: int, high: int):
    if high - low == 0:
        return F.lit(len(bounds) - low)
    if high - low <= 8:
        out = F.lit(len(bounds) - high)
        for b in bounds[low:high]:
            out = out + (x <= b).cast("int")
        return out
    mid = (low + high) // 2
    return F.when(x <= bounds[mid], _above(bounds, x, low, mid)).otherwise(_above(bounds, x, mid + 1, high))


def edited(text: str, after: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``after``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each row of docs(doc_id, text), of its edited text, and their likeness to each other and to the next row's.

    A null text counts as empty and has an empty fingerprint. The row after the last is the first,
    so a single row is next to itself. Rows with equal ids are in order of text. An empty table
    gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def row(doc_id, text, mark, after, after_mark):
        new = edited(text, after)
        own = fingerprint(_codes(new))
        return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), told(mark), told(own), likeness(mark, own), likeness(mark, after_mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(start, 256)
                for k, ghost, doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if ghost and (held is None or held[0] != k):
                        continue  # one ghost ends a run; rows with its id that follow add nothing
                    mark = fingerprint(_codes(text))
                    if held is not None and held[0] == k:
                        out.append(row(*held[1:], text, mark))
                    held = None if ghost else (k, doc_id, text, mark)
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    spark = docs.sparkSession
    runs = with_next(docs).repartition(partitions(spark), "run")
    runs = runs.sortWithinPartitions("run", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    return runs.mapInArrow(run, schema)


def op7_syncmer_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))

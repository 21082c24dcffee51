"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through fast Hadamard pseudo-rotations to the nearest signed axis, one per table.
The tables are over the queries, which come in chunks of a bounded size and are broadcast: a query
is put in the cells of its few nearest axes (multiprobe), a vector meets the queries of its own
cell. Candidates are reranked by exact distances on the original vectors. No vector is shuffled,
only the best candidates of each task are; a first pass over a bounded part of the vectors gives
each query an upper bound of its last distance, so that few candidates leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES, Scratch, read_table

BLOCK = 8192
SUB_BLOCK = 256
QUERY_BLOCK = 4096


@dataclass(frozen=True)
class Settings:
    """``tables`` and ``probes`` set the recall; ``first_rows`` bounds the vectors of the first pass, roughly."""

    tables: int = 7
    probes: int = 12
    rounds: int = 3
    seed: int = 99
    first_rows: int = 8192


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Pseudo-rotations of rows: for each row of signs, a change of signs and a fast Hadamard transform."""
    size = signs.shape[1]
    y = np.zeros((len(x), size), dtype=np.float32)
    y[:, : x.shape[1]] = x
    for s in signs:
        y *= s
        h = 1
        while h < size:
            z = y.reshape(len(y), size // (2 * h), 2, h)
            y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(len(y), size)
            h *= 2
        y *= np.float32(size**-0.5)
    return y


def axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes of rotated rows, nearest first."""
    both = np.concatenate((y, -y), axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return top


def _signs(dim: int, s: Settings) -> np.ndarray:
    size = 1 << max(0, dim - 1).bit_length()
    return np.random.Generator(np.random.PCG64(s.seed)).choice(np.array([-1, 1], dtype=np.float32), (s.tables, s.rounds, size))


class Tables:
    """A chunk of queries and their cells."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, s: Settings, bound: np.ndarray | None = None):
        self.ids, self.q, self.k, self.s = ids, vectors.astype(np.float64), k, s
        self.bound = np.full(len(ids), np.inf) if bound is None else bound.copy()
        self.square = (self.q**2).sum(axis=1)
        self.signs = _signs(vectors.shape[1], s)
        unit = (self.q / np.sqrt(self.square)[:, None]).astype(np.float32)
        self.cells = [_members(axes(rotate(unit, z), s.probes), 2 * self.signs.shape[2]) for z in self.signs]

    def block(self, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, distance) of candidates of a block of vectors that are within the bounds; a pair may come from several tables."""
        square = (x**2).sum(axis=1)
        unit = (x / np.sqrt(square)[:, None]).astype(np.float32)
        for signs, cells in zip(self.signs, self.cells, strict=True):
            own = axes(rotate(unit, signs), 1)[:, 0]
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(len(cells) + 1))
            for cell, asked in enumerate(cells):
                if not len(asked):
                    continue
                for at in range(cuts[cell], cuts[cell + 1], SUB_BLOCK):
                    v = order[at : min(at + SUB_BLOCK, cuts[cell + 1])]
                    for c in range(0, len(asked), QUERY_BLOCK):
                        w = asked[c : c + QUERY_BLOCK]
                        both = square[v, None] + self.square[None, w]
                        near = both - 2 * (x[v] @ self.q[w].T)
                        i, j = np.nonzero((near <= self.bound[None, w] ** 2 + 1e-9 * both) & (ids[v, None] != self.ids[None, w]))
                        for n in range(0, len(i), 1 << 16):
                            e, f = v[i[n : n + (1 << 16)]], w[j[n : n + (1 << 16)]]
                            yield f, ids[e], np.sqrt(((x[e] - self.q[f]) ** 2).sum(axis=1))

    def best(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest k of each query among candidates; bounds fall to the last of k."""
        q, ids, d = (np.concatenate(v) for v in zip(*parts, strict=True))
        order = np.lexsort((d, ids, q))  # repeated rows of an id: the nearest counts
        q, ids, d = q[order], ids[order], d[order]
        new = np.ones(len(q), dtype=bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, d = q[new], ids[new], d[new]
        order = np.lexsort((ids, d, q))
        q, ids, d = q[order], ids[order], d[order]
        head = np.searchsorted(q, np.arange(len(self.ids)))
        place = np.arange(len(q)) - head[q]
        full = place == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], d[full])
        top = place < self.k
        return q[top], ids[top], d[top]


def _members(near: np.ndarray, cells: int) -> list[np.ndarray]:
    """For each cell, the rows that have it among their nearest axes."""
    row = np.repeat(np.arange(len(near)), near.shape[1])
    order = np.argsort(near.ravel(), kind="stable")
    return np.split(row[order], np.searchsorted(near.ravel()[order], np.arange(1, cells)))


def _plain(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Rows with an id whose vectors aren't null or zero and have finite components only, of any length."""
    v = F.col(embedding)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull() & plain & F.exists(v, lambda x: x != 0))


def usable(vectors: DataFrame, vec_id: str, embedding: str, dim: int) -> DataFrame:
    v = F.col(embedding)
    kept = _plain(vectors, vec_id, embedding).filter(F.size(v) == dim)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _scan(vectors: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, k, s, bound = shared.value
        tables, held, count = Tables(ids, q, k, s, bound), [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                for part in tables.block(b.column(0).to_numpy(), x):
                    held.append(part)
                    count += len(part[0])
                    if count > 1 << 20:
                        held = [tables.best(held)]
                        count = len(held[0][0])
        if held:
            found, near, d = tables.best(held)
            for i in range(0, len(found), 1 << 16):
                z = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(ids[found[z]]), pa.array(near[z]), pa.array(d[z])], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, s: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the nearest k found of each row of queries.

    A query for which hashing finds fewer than k is searched again among all vectors, exactly.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids, nor
    vectors of another length than most of the others (the shortest of equally common lengths). A query doesn't find its own id. Ties go to the smaller
    id. Of repeated rows of an id the nearest counts once; a query id with several vectors is the
    smallest of them. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    some = _plain(vectors, vec_id, embedding).select(F.size(embedding).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").head(1)
    dim = some[0]["n"] if some else 1
    rows = usable(vectors, vec_id, embedding, dim)
    asked = usable(queries, vec_id, embedding, dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    scratch = Scratch(spark, "nearest")
    asked = scratch.save(asked, "queries")
    n_queries, n_rows = asked.count(), rows.count()
    chunks = max(1, -(-n_queries * (8 * dim + 16) // BROADCAST_BYTES))
    part = max(1, n_rows // s.first_rows)
    found = None
    for c in range(chunks):
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).orderBy("vec_id").toArrow()
        if not mine.num_rows:
            continue
        ids = mine.column("vec_id").to_numpy()
        q = mine.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        bound = np.full(len(ids), np.inf)
        if part > 1:
            # bounds from a part of the vectors; they only spare the second pass, over all, candidates that can't be in the result
            first = _top(_scan(rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(part)) == 0), spark.sparkContext.broadcast((ids, q, k, s, bound))), k)
            last = first.filter(F.col("rank") == k).select("query_id", "score").toArrow()
            bound[np.searchsorted(ids, last.column("query_id").to_numpy())] = last.column("score").to_numpy()
        got = scratch.save(_top(_scan(rows, spark.sparkContext.broadcast((ids, q, k, s, bound))), k), f"found-{c}")
        full = got.filter(F.col("rank") == k).select("query_id").toArrow().column("query_id").to_numpy()
        short = ~np.isin(ids, full)
        if short.any():
            # too few vectors in a query's cells: with all axes as probes, one table meets every vector
            every = replace(s, tables=1, probes=2 * _signs(dim, s).shape[2])
            rest = _scan(rows, spark.sparkContext.broadcast((ids[short], q[short], k, every, bound[short])))
            rest = scratch.save(_top(rest, k), f"rest-{c}")
            got = got.join(F.broadcast(spark.createDataFrame([(int(i),) for i in ids[short]], "short long")), F.col("query_id") == F.col("short"), "left_anti").unionAll(rest)
        found = got if found is None else found.unionAll(got)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0))

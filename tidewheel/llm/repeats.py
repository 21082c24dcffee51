r"""Substring dedup: words in long spans that also occur in a document with a smaller id.

Windows of k words are the edges of a de Bruijn graph, from their first to their last k - 1 words.
Each edge belongs to the bucket of its minimizer, the least hash of the m-grams in it, which equal
edges share. Runs of edges with one minimizer travel together, as the words of the run:

1. Equal texts are one node: the smallest document with a text stands for it, all words of the
   others go. Texts are equal if their SHA-256 digests are. Minimizers that occur in one text only
   are ruled out, and the edges under them. Minimizers with many different edges, as a phrase has
   that stands in many texts with other words around it, are heavy: each of their edges goes to the
   bucket of its own hash, so that no bucket grows with such a phrase.
2. In each unit of some megabytes of text, edges are settled against the smallest document there, so
   that a very common passage brings an entry for each unit only. The rest goes to its buckets,
   where edges are settled against the smallest document of all, the source.
3. Edges that follow one another in a document and in its source compact to one path: inside a
   bucket at once, across buckets by joining pieces along their coordinates. A path ends where the
   document leaves its source; third documents that branch off inside don't cut it, as that
   changes no word that goes.
4. Hashes only propose. Each piece's words are compared, byte by byte, with those at its source's
   coordinates, before anything is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, partitions, read_table, small_side, trimmed
from .textblocks import Words, blocks, mix, ngrams, text_array

#: Bytes of text whose edges are settled against one another before anything is shuffled (or one text, if that is longer).
UNIT_BYTES = 4 << 20
#: Bytes of text for each bucket, roughly, and the most partitions they are dealt to; a task takes one bucket at a time.
BUCKET_BYTES, MOST_PARTITIONS = 8 << 20, 20_000
#: Words of runs that are gathered at once.
RUN_WORDS = 1 << 17
#: A minimizer with more edges than that, each unit's different ones counted, is heavy.
HEAVY_EDGES = 1 << 13
LAST = 2**63 - 1


class Edges:
    """The edges of some rows of words: edge i begins at word i; ``valid`` tells those that end in the same row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, m: int = 0):
        self.words = w = Words(data, offsets)
        self.k = k
        n = max(0, len(w.start) - k + 1)
        self.row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(w.first))[: len(w.start)]
        self.valid = np.flatnonzero(self.row[:n] == self.row[k - 1 : k - 1 + n])
        h = w.hashes()
        self.least = None
        if m:
            grams = ngrams(h, m, salt=1)
            self.least = grams[:n].copy()
            for j in range(1, k - m + 1):
                np.minimum(self.least, grams[j : n + j], out=self.least)
            del grams
        self.edge = ngrams(h, k)

    def check(self) -> np.ndarray:
        """A second hash of each edge, from other hashes of its words."""
        return ngrams(self.words.hashes(1), self.k, salt=2)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    return new


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... n of them, of each pair."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum())) + np.repeat(start - before, n)


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Slices of runs of n words, of RUN_WORDS words or little more each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // RUN_WORDS)) + 1
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True):
        if x < y:
            yield slice(x, y)


def _run_bytes(w: Words, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of runs of n words from word start on, each word with a space after it; and the runs' sizes in bytes."""
    out, sizes = [np.zeros(0, dtype=np.uint8)], [np.zeros(0, dtype=np.int64)]
    for z in _parts(n):
        words = _spread(start[z], n[z])
        size = w.end[words] - w.start[words]
        told = np.full(int(size.sum()) + len(words), 32, dtype=np.uint8)
        told[_spread(np.cumsum(size + 1) - size - 1, size)] = w.data[_spread(w.start[words], size)]
        out.append(told)
        sizes.append(np.add.reduceat(size + 1, np.cumsum(n[z]) - n[z]))
    return np.concatenate(out), np.concatenate(sizes)


@dataclass
class Pieces:
    """Runs of edges that a smaller document has too: first edge and number, and the source's first edge."""

    start: np.ndarray
    n: np.ndarray
    source: np.ndarray


def settle(e: Edges, some: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, Pieces]:
    """Of the edges ``some`` (in order): which occur in no smaller document, and pieces of those that do.

    doc and place tell each row's document and the place of its first word there. The source of an
    edge is its first place in the smallest document.
    """
    row = e.row[some]
    own, at = doc[row], place[row] + some - e.words.first[row]
    edge, check = e.edge[some], e.check()[some]
    order = np.lexsort((at, own, check, edge))
    head = np.flatnonzero(_heads(edge[order], check[order])) if len(order) else np.zeros(0, dtype=np.int64)
    source = np.empty(len(some), dtype=np.int64)
    source[order] = np.repeat(order[head], np.diff(np.append(head, len(order))))
    late = own > own[source]
    i, s = some[late], some[source[late]]
    if not len(i):
        return ~late, Pieces(i, i, i)
    new = _heads(row[late])
    new[1:] |= (i[1:] != i[:-1] + 1) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    out = Pieces(i[first], np.diff(np.append(first, len(i))), s[first])
    for z in _parts(out.n + e.k - 1):
        a, b = (_run_bytes(e.words, c[z], out.n[z] + e.k - 1) for c in (out.start, out.source))
        if not (np.array_equal(a[1], b[1]) and np.array_equal(a[0], b[0])):
            raise ValueError("edges of unequal words have equal hashes")
    return ~late, out


def _rank(sigs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sig, doc) sorted, with the place of each among its sig's documents and their number."""
    order = np.lexsort((docs, sigs))
    sigs, docs = sigs[order], docs[order]
    one = _heads(sigs, docs)
    sigs, docs = sigs[one], docs[one]
    head = np.flatnonzero(_heads(sigs)) if len(sigs) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(head, len(sigs)))
    return sigs, docs, np.arange(len(sigs)) - np.repeat(head, count), np.repeat(count, count)


def _shared(docs: DataFrame, k: int, m: int, buckets: int, unit: int, heavy: int) -> DataFrame:
    """(told, sig, heavy): minimizers that occur in two texts or more, for each text (by its hash ``told``) that has them.

    A unit sends the first two texts of a minimizer and the number of its different edges; texts after
    them have their answer already, but for ``heavy``, which is null there."""
    names = ["bucket", "sigs", "rest"]
    asked = np.dtype([("doc", np.int64), ("n", np.int64)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for start, _, data, offsets in blocks(text_array(b.column(1)), unit):
                e = Edges(data, offsets, k, m)
                if not len(e.valid):
                    continue
                row, least, edge = e.row[e.valid], e.least[e.valid], e.edge[e.valid]
                del e  # what follows needs none of its other arrays
                few = _heads(row, least)
                sig, doc, place, _ = _rank(least[few], ids[start + row[few]])
                order = np.argsort(edge)
                one = order[_heads(edge[order])]
                kinds, n = np.unique(least[one], return_counts=True)
                del row, least, edge, few, order, one
                known, ask = place > 1, place <= 1
                rows = [(-1 - int(doc[known][0] % buckets), sig[known].tobytes(), doc[known].tobytes())] if known.any() else []
                rest = np.zeros(int(ask.sum()), dtype=asked)
                rest["doc"], rest["n"] = doc[ask], np.where(place[ask] == 0, n[np.searchsorted(kinds, sig[ask])], 0)
                sig = sig[ask]
                to = (mix(sig) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((rest["doc"], to))
                sig, rest, to = sig[order], rest[order], to[order]
                cuts = [*np.flatnonzero(_heads(to)).tolist(), len(to)]
                rows += [(int(to[x]), sig[x:y].tobytes(), rest[x:y].tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)]
                cols = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, sigs, rest in _buckets(batches):
            sig = np.frombuffer(sigs, np.uint64)
            if bucket < 0:
                doc, big = np.frombuffer(rest, np.int64), None
            else:
                rest = np.frombuffer(rest, asked)
                kinds, at = np.unique(sig, return_inverse=True)
                many = np.bincount(at, weights=rest["n"], minlength=len(kinds)) > heavy
                sig, doc, _, count = _rank(sig, rest["doc"])
                sig, doc = sig[count > 1], doc[count > 1]
                big = many[np.searchsorted(kinds, sig)]
            for i in range(0, len(sig), 1 << 16):
                z = slice(i, i + (1 << 16))
                flags = pa.nulls(len(sig[z]), pa.bool_()) if big is None else pa.array(big[z])
                yield pa.RecordBatch.from_arrays([pa.array(doc[z]), pa.array(sig[z].view(np.int64)), flags], ["told", "sig", "heavy"])

    told = docs.select("told", "text").mapInArrow(trimmed(send), "bucket int, sigs binary, rest binary")
    return _dealt(told, buckets).mapInArrow(trimmed(meet), "told long, sig long, heavy boolean")


def _sigs(shared: DataFrame) -> DataFrame:
    """(told, sigs, heavy): the shared minimizers of each text, and those of them that are heavy."""
    big = shared.filter("heavy").select(F.col("sig").alias("big")).distinct()
    rows = shared.select("told", "sig").join(small_side(big, 8), F.col("sig") == F.col("big"), "left")
    return rows.groupBy("told").agg(F.collect_set("sig").alias("sigs"), F.collect_set("big").alias("heavy"))


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(min(buckets, MOST_PARTITIONS), "bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, its first column joined, its second) of rows sorted by bucket."""
    now, one, two = None, [], []
    for b in batches:
        for bucket, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket != now and one:
                yield now, b"".join(one), b"".join(two)
                one, two = [], []
            now = bucket
            one.append(x)
            two.append(y)
    if one:
        yield now, b"".join(one), b"".join(two)


_PIECE = "doc long, told long, start int, end int, owner long, shift int"


def _told(doc: np.ndarray, told: np.ndarray, start: np.ndarray, n: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pieces as rows of _PIECE."""
    return np.stack([doc, told, start, start + n - 1, owner, at - start], axis=1)


def _having(e: Edges, cuts: np.ndarray, sigs: pa.Array, start: int) -> Iterator[np.ndarray]:
    """For each row of a block, which of the valid edges have a minimizer of the row's list."""
    for r, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if len(own := sigs[start + r].values.to_numpy().view(np.uint64)):
            yield x + np.flatnonzero(np.isin(e.least[e.valid[x:y]], own))


def _pieces(docs: DataFrame, k: int, m: int, buckets: int, unit: int) -> DataFrame:
    """Pieces of paths of docs(doc, told, text, sigs, heavy), as in _PIECE: places of a document's edges, and how far on they are in the owner."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, sigs, heavy = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3), b.column(4)
            for start, end, data, offsets in blocks(text_array(b.column(2)), unit):
                e = Edges(data, offsets, k, m)
                doc, told, w = ids[start:end], hashes[start:end], e.words
                row = e.row[e.valid]
                cuts = np.searchsorted(row, np.arange(end - start + 1))
                some = e.valid[np.concatenate([np.zeros(0, np.int64), *_having(e, cuts, sigs, start)])]
                # edges under a heavy minimizer go by their own hash
                own = e.valid[np.concatenate([np.zeros(0, np.int64), *_having(e, cuts, heavy, start)])]
                e.least[own] = mix(e.edge[own] + np.uint64(1))
                ask, done = settle(e, some, doc, np.zeros(end - start, dtype=np.int64))
                rows = []
                if len(done.n):
                    own, of = e.row[done.start], e.row[done.source]
                    found = _told(doc[own], told[own], done.start - w.first[own], done.n, doc[of], done.source - w.first[of])
                    rows.append((-1 - int(doc[0] % buckets), found.tobytes(), b""))
                i = some[ask]
                if len(i):
                    new = _heads(e.row[i], e.least[i])
                    new[1:] |= i[1:] != i[:-1] + 1
                    first = np.flatnonzero(new)
                    n, i = np.diff(np.append(first, len(i))), i[first]
                    to = (mix(e.least[i]) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    i, n, to = i[order], n[order], to[order]
                    own = e.row[i]
                    text, size = _run_bytes(w, i, n + k - 1)
                    heads = np.stack([doc[own], told[own], i - w.first[own], size], axis=1)
                    ends, cuts = np.cumsum(size), [*np.flatnonzero(_heads(to)).tolist(), len(to)]
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        rows.append((int(to[x]), heads[x:y].tobytes(), text[ends[x] - size[x] : ends[y - 1]].tobytes()))
                if rows:
                    cols = zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], ["bucket", "heads", "text"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, heads, text in _buckets(batches):
            if bucket < 0:
                yield from out(np.frombuffer(heads, np.int64).reshape(-1, 6))
                continue
            doc, told, place, size = np.frombuffer(heads, np.int64).reshape(-1, 4).T
            e = Edges(np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum(size))), k)
            _, late = settle(e, e.valid, doc, place)
            own, of = e.row[late.start], e.row[late.source]
            start, source = place[own] + late.start - e.words.first[own], place[of] + late.source - e.words.first[of]
            yield from out(_told(doc[own], told[own], start, late.n, doc[of], source))

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32)
        for i in range(0, len(rows), 1 << 16):
            cols = [pa.array(np.ascontiguousarray(rows[i : i + (1 << 16), j]).astype(t)) for j, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PIECE.split(", ")])

    told = docs.select("doc", "told", "text", "sigs", "heavy").mapInArrow(trimmed(send), "bucket int, heads binary, text binary")
    return _dealt(told, buckets).mapInArrow(trimmed(meet), _PIECE)


def _texts(docs: DataFrame) -> DataFrame:
    """(told, other, first, copies) of each text of docs(doc, told, other): a hash and a digest, its smallest document and whether larger ones have it too."""
    found = docs.groupBy("told", "other").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    return found.select("told", "other", "first", (F.col("first") < F.col("last")).alias("copies"))


def repeated_paths(docs: DataFrame, texts: DataFrame, scratch: Scratch, k: int = 13, m: int = 8, unit: int = UNIT_BYTES, heavy: int = HEAVY_EDGES) -> DataFrame:
    """(doc, told, start, end, owner, shift): paths of edges start..end of a document that ``owner``, a smaller one, has at start + shift.

    docs has doc, told, other and text, and each of texts is looked at in its first document only."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(partitions(docs.sparkSession), size // BUCKET_BYTES)
    sigs = _sigs(scratch.save(_shared(docs, k, m, buckets, unit, heavy), "shared")).withColumnRenamed("told", "t")
    some = texts.join(sigs, F.col("told") == F.col("t")).select("t", F.col("other").alias("o"), "first", "sigs", "heavy")
    some = docs.join(some, (F.col("told") == F.col("t")) & (F.col("other") == F.col("o")) & (F.col("doc") == F.col("first")))
    pieces = scratch.save(_pieces(some, k, m, buckets, unit), "pieces")
    scratch.drop("shared")
    # pieces that touch along a document and its source are one path
    along = Window.partitionBy("doc", "told", "owner", "shift").orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    path = F.sum(F.when(F.col("start") <= F.col("before") + 1, 0).otherwise(1)).over(along)
    paths = pieces.withColumn("before", before).withColumn("path", path)
    return paths.groupBy("doc", "told", "owner", "shift", "path").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("path")


def _cut(k: int):
    """A function of (text, whether all its edges go, first edges, last edges of its paths) to (n_words, n_removed, kept)."""

    def cut(texts: pa.Array, copies: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        n, gone, kept = [], [], []
        for first, _, data, offsets in blocks(text_array(texts)):
            w = Words(data, offsets)
            for row, (x, y) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                n.append(y - x)
                left = np.arange(x, y)
                if copies[first + row].as_py() and y - x >= k:
                    left = left[:0]
                elif starts[first + row].is_valid and not copies[first + row].as_py():
                    step = np.zeros(y - x + 1, dtype=np.int64)
                    np.add.at(step, starts[first + row].values.to_numpy(), 1)
                    np.add.at(step, ends[first + row].values.to_numpy() + k, -1)
                    left = x + np.flatnonzero(np.cumsum(step[:-1]) == 0)
                gone.append(y - x - len(left))
                new = np.flatnonzero(_heads(left - np.arange(len(left)))) if len(left) else left
                text, _ = _run_bytes(w, left[new], np.diff(np.append(new, len(left))))
                kept.append(text[:-1].tobytes().decode())
        cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(cols, ["n_words", "n_removed", "kept"])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield cut(*batch)

    return F.arrow_udf(trimmed(run), "n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, k: int = 13, m: int = 8, keep: tuple[str, ...] = ("doc_id",), unit: int = UNIT_BYTES, heavy: int = HEAVY_EDGES) -> DataFrame:
    """The columns ``keep`` of docs(doc_id, text, ...), n_words, n_removed and kept (the words left, joined by a space).

    A word goes if a window of k words over it also starts in a document with a smaller doc_id;
    windows are those of the input. A null text has no words. A null doc_id comes after every
    other; rows with one id are one document to each other, so they take nothing from each other,
    whatever their texts. Repeated rows give repeated rows, an empty table gives none. Other columns
    aren't read, whatever their names, but ``keep`` may not hold n_words, n_removed or kept. A text
    longer than a unit is a unit of its own, and has to fit in a task with some 30 bytes for each of its own.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    doc, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.coalesce(docs["text"].cast("string"), F.lit(""))
    hashes = [F.xxhash64(text), F.unhex(F.sha2(text.cast("binary"), 256))]
    plain = docs.select(doc.alias("doc"), hashes[0].alias("told"), hashes[1].alias("other"), text.alias("text"))
    texts = scratch.save(_texts(plain), "texts")
    spans = repeated_paths(plain, texts, scratch, k, m, unit, heavy).groupBy(F.col("doc").alias("d"), F.col("told").alias("t")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    # what is to be done with a text: all of it goes but in its first document, and there the spans do
    told = texts.join(spans, (F.col("first") == F.col("d")) & (F.col("told") == F.col("t")), "left").filter("copies OR spans IS NOT NULL")
    told = scratch.save(told.select("told", "other", "first", "spans"), "told")
    scratch.drop("pieces")
    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], doc.alias("_d"), hashes[0].alias("_t"), hashes[1].alias("_o"), text.alias("_text"))
    rows = rows.join(told, (F.col("_t") == F.col("told")) & (F.col("_o") == F.col("other")), "left")
    copy = F.coalesce(F.col("_d") > F.col("first"), F.lit(False))
    rows = rows.withColumn("_new", _cut(k)("_text", copy, F.col("spans.start"), F.col("spans.end")))
    return rows.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "_new.n_words", "_new.n_removed", "_new.kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)
), windows AS (
  SELECT doc_id, i, md5(string_agg(w, ' ') OVER f) AS h, count(*) OVER f AS n FROM words
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), firsts AS (
  SELECT h, min(doc_id) AS owner FROM windows WHERE n = 13 GROUP BY h
), late AS (
  SELECT w.doc_id, w.i FROM windows w JOIN firsts f USING (h) WHERE w.n = 13 AND f.owner < w.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM late, range(0, 13) AS r(j)
), marked AS (
  SELECT w.doc_id, w.i, w.w, g.i IS NOT NULL AS gone FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i
), told AS (
  SELECT doc_id, count(*)::BIGINT AS n_words, (count(*) FILTER (gone))::BIGINT AS n_removed,
    sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_words, 0)::BIGINT AS n_words, coalesce(t.n_removed, 0)::BIGINT AS n_removed, coalesce(t.kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN told t ON d.doc_id = t.doc_id
"""

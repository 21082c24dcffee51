r"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and their components.

1. Equal sets are brought together by a hash of 128 bits; from here on a set counts once.
2. n-grams are counted. A link shares num/den of a set's n-grams at least, so sets with fewer n-grams
   that another one has go. They are dealt by hash, packed, and only counts for each set come back.
3. Of the sets left, two linked ones share one of the rarest few n-grams of either (the prefix).
   Components of sets that share such an n-gram are classes.
4. Inside a class, links are found by T-occurrence search as DivideSkip does it: the short
   inverted lists of a query are merged on a heap with skips, the long ones are probed by binary
   search, and documents that reach the required overlap are links. A search goes on from the
   documents found, among those not reached yet, so a class of near copies takes few searches.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, partitions, read_table, small_side, trimmed
from .textblocks import Words, blocks, mix, ngrams, text_array

#: n-grams that are searched at once, roughly; larger classes are cut in blocks and searched by pairs of blocks.
CELL_NGRAMS = 1 << 21
#: Weight of long lists in DivideSkip's rule for how many lists are long.
MU = 0.0085
#: n-grams of a bucket, roughly, and the most partitions that buckets are dealt to; a task takes one bucket at a time.
BUCKET_NGRAMS, MOST_PARTITIONS = 1 << 20, 20_000
#: n-grams whose sets are settled against one another before anything is shuffled.
UNIT_NGRAMS = 1 << 20
NOBODY = -1


def ngram_sets(texts: pa.Array, n: int, lower: bool) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of word n-grams of each text; of fewer than n words, one hash of them all."""
    for start, end, data, offsets in blocks(text_array(texts)):
        words = Words(data, offsets, lower)
        h, first = words.hashes(), words.first
        grams = ngrams(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield ngrams(h[a:b], b - a, salt=1)
            else:
                yield grams[:0]


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    if len(s) == 0:
        return 0, 0
    one = np.add.reduce(mix(s + np.uint64(11))) + np.uint64(len(s))
    two = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    both = mix(np.array([one, two], dtype=np.uint64)).view(np.int64)
    return int(both[0]), int(both[1])


def _sets(docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """doc_id, size and hash of the set, and a hash of the text, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), *set_hash(s)) for s in ngram_sets(b.column(1), n, lower)]
            cols = zip(*rows, strict=True) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols], b.column(2)], ["doc_id", "n", "h1", "h2", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(trimmed(run), "doc_id long, n long, h1 long, h2 long, text_hash long")


def _within_reach(docs: DataFrame, n: int, lower: bool, num: int, den: int, total: int) -> DataFrame:
    """(h): hashes of the sets that may link, as num/den of their n-grams are in another row's set.

    n-grams go to buckets as packed arrays, one for each unit of some UNIT_NGRAMS n-grams and bucket.
    What two sets of a unit have is settled there and goes out once, so a very common n-gram brings
    an entry for each unit. A bucket answers with one row of counts for each unit. An equal set of
    another unit counts too, which only keeps more."""
    buckets = max(partitions(docs.sparkSession), total // BUCKET_NGRAMS)
    most = min(buckets, MOST_PARTITIONS)
    names = ["bucket", "unit", "a", "b", "c"]

    def unit(k: int, sets: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        number = TaskContext.get().partitionId() << 32 | k
        hashes = np.array([h for h, _ in sets], dtype=np.int64)
        sizes = np.array([len(s) for s in sets.values()], dtype=np.int64)
        grams, at, times = np.unique(np.concatenate(list(sets.values())), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        known = np.bincount(owner[times[at] > 1], minlength=len(sizes))
        whose = np.full(len(grams), NOBODY, dtype=np.int64)
        whose[at[times[at] == 1]] = owner[times[at] == 1]
        to = (mix(grams) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((whose, to))
        grams, whose, to = grams[order], whose[order], to[order]
        cuts = [*np.flatnonzero(np.diff(to, prepend=-1)).tolist(), len(to)]
        rows = [(-1 - number % most, number, hashes.tobytes(), sizes.tobytes(), known.tobytes())]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own, counts = np.unique(whose[x:y], return_counts=True)
            rows.append((int(to[x]), number, grams[x:y].tobytes(), own.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes()))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size, k = {}, 0, 0
        for b in batches:
            for s in ngram_sets(b.column(0), n, lower):
                key = set_hash(s)
                if len(s) and key not in sets:
                    sets[key] = s
                    size += len(s)
                if size >= UNIT_NGRAMS:
                    yield unit(k, sets)
                    sets, size, k = {}, 0, k + 1
        if sets:
            yield unit(k, sets)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _runs(batches):
            if bucket < 0:
                yield from answer([(u, True, a, b + c) for u, a, b, c in rows])
                continue
            grams = [np.frombuffer(a, np.uint64) for _, a, _, _ in rows]
            _, at, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
            shared = times > 1
            owners = []
            start = 0
            for g, (_, _, b, c) in zip(grams, rows, strict=True):  # what two sets of a unit have is shared in any case
                own = np.repeat(np.frombuffer(b, np.int32), np.frombuffer(c, np.int32))
                shared[at[start : start + len(g)][own == NOBODY]] = True
                owners.append(own)
                start += len(g)
            start, out = 0, []
            for own, (u, _, _, _) in zip(owners, rows, strict=True):
                told = own[shared[at[start : start + len(own)]] & (own != NOBODY)]
                some, number = np.unique(told, return_counts=True)
                out.append((u, False, some.astype(np.int32).tobytes(), number.astype(np.int32).tobytes()))
                start += len(own)
            yield from answer(out)

    def answer(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["unit", "head", "a", "b"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches):
            head = [(a, b) for is_head, a, b in rows if is_head]
            if len(head) != 1:
                raise ValueError("rows came in another order when a part of them was read again")
            hashes = np.frombuffer(head[0][0], np.int64)
            sizes, known = np.frombuffer(head[0][1], np.int64).reshape(2, -1)
            known = known.copy()
            for is_head, a, b in rows:
                if not is_head:
                    known[np.frombuffer(a, np.int32)] += np.frombuffer(b, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[known * den >= sizes * num])], ["h"])

    told = docs.select("text").mapInArrow(trimmed(send), "bucket int, unit long, a binary, b binary, c binary")
    told = told.repartition(most, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(meet), "unit long, head boolean, a binary, b binary")
    return told.repartition(partitions(docs.sparkSession), "unit").sortWithinPartitions("unit").mapInArrow(trimmed(gather), "h long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(value of the first column, rows of the others) of runs of rows sorted by that column."""
    now, rows = None, []
    for b in batches:
        for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != now and rows:
                yield now, rows
                rows = []
            now = key
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _rarest_first(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, size, shared) of the rows of sets(node, ngrams) that may link: those n-grams that other sets have too, rarest first."""
    grams = sets.select("node", F.size("ngrams").alias("size"), F.explode("ngrams").alias("gram"))
    counts = grams.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("sets")).filter("sets > 1")
    grams = grams.join(counts, F.col("gram") == F.col("g"))
    shared = F.sort_array(F.collect_list(F.struct("sets", "gram")))
    shared = grams.groupBy("node", "size").agg(shared.alias("shared")).filter(F.size("shared") * den >= F.col("size") * num)
    return shared.select("node", "size", F.col("shared.gram").alias("shared"))


def _classes(reach: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(node, root): components of the rows of reach(node, size, shared) that share an n-gram of their prefixes."""
    # at most size - ceil(size * num / den) n-grams aren't in a linked set; those of no other set come first of all
    spare = F.col("size") - F.ceil(F.col("size") * num / den) - (F.col("size") - F.size("shared")) + 1
    prefix = reach.select("node", F.explode(F.slice("shared", F.lit(1), spare.cast("int"))).alias("gram"))
    first = prefix.groupBy(F.col("gram").alias("g")).agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").drop("high")
    edges = prefix.join(first, F.col("gram") == F.col("g")).select(F.col("node").alias("a"), F.col("low").alias("b"))
    found = components(edges, scratch, "classes")
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())


def heap_merge(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(document, count) of the documents in at least ``need`` of the sorted lists; lists that can't matter skip ahead."""
    heap = [(x[0], k) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while len(heap) >= need:
        d = heap[0][0]
        popped = []
        while heap and heap[0][0] == d:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            out.append((d, len(popped)))
            for k in popped:
                at[k] += 1
                if at[k] < len(lists[k]):
                    heapq.heappush(heap, (lists[k][at[k]], k))
            continue
        while heap and len(popped) < need - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        reach = heap[0][0]
        for k in popped:
            at[k] = bisect_left(lists[k], reach, at[k])
            if at[k] < len(lists[k]):
                heapq.heappush(heap, (lists[k][at[k]], k))
    return out


class Lists:
    """Inverted lists of the sets that are alive: for each n-gram, its sets in order."""

    def __init__(self, token: np.ndarray, owner: np.ndarray, n_tokens: int, n_sets: int):
        self.n_sets = n_sets
        self.flat = np.sort(token * n_sets + owner)
        self.bound = np.searchsorted(self.flat, np.arange(n_tokens + 1) * n_sets)
        self.lengths = np.diff(self.bound)

    def list_of(self, token: int) -> np.ndarray:
        return self.flat[self.bound[token] : self.bound[token + 1]] - token * self.n_sets

    def holds(self, tokens: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """In how many of the lists each document is, by binary search."""
        keys = tokens[:, None] * self.n_sets + docs[None, :]
        spot = np.minimum(np.searchsorted(self.flat, keys), len(self.flat) - 1)
        return (self.flat[spot] == keys).sum(axis=0)


def search(sets: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links (i, j) that span the components of sets(i); sizes may count n-grams that are in no other set and aren't listed.

    Each set is the query of one search among the sets that no search has reached yet; those that it
    links with are reached, and asked next. So every component is spanned, and no pair is asked twice.
    """
    n_sets = len(sets)
    owner = np.repeat(np.arange(n_sets, dtype=np.int64), [len(s) for s in sets])
    _, token, df = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    shared = df[token] > 1  # an n-gram of one set only is in no overlap
    token, owner = token[shared].astype(np.int64), owner[shared]
    mine = np.split(token, np.searchsorted(owner, np.arange(1, n_sets)))
    alive = np.ones(n_sets, dtype=bool)
    lists, listed, left = Lists(token, owner, len(df), n_sets), n_sets, n_sets
    links = []
    for seed in range(n_sets):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        ask = [seed]
        while ask and left:
            q = ask.pop()
            if 2 * left < listed:  # fewer than half of the sets in the lists are alive: new lists
                some = alive[owner]
                lists, listed = Lists(token[some], owner[some], len(df), n_sets), left
            found = _linked(q, mine[q], int(sizes[q]), sizes, alive, lists, num, den)
            alive[found] = False
            left -= len(found)
            links += [(q, d) for d in found]
            ask += found
    return links


def _linked(q: int, tokens: np.ndarray, n: int, sizes: np.ndarray, alive: np.ndarray, lists: Lists, num: int, den: int) -> list[int]:
    """The sets alive that link with set q of n n-grams, by DivideSkip."""
    least = -(-n * num // den)
    t = -(-num * (n + least) // (num + den))  # a link with the smallest partner shares so many
    tokens = tokens[lists.lengths[tokens] > 0]
    if n == 0 or len(tokens) < t:
        return []
    tokens = tokens[np.argsort(lists.lengths[tokens], kind="stable")]
    n_long = min(t - 1, int(t / (MU * math.log2(int(lists.lengths[tokens[-1]]) + 1) + 1)))
    short, long = tokens[: len(tokens) - n_long], tokens[len(tokens) - n_long :]
    merged = []
    for x in short.tolist():
        own = lists.list_of(x)
        merged.append(own[alive[own] & (least <= sizes[own]) & (sizes[own] * num <= n * den)].tolist())
    found = heap_merge(merged, t - n_long)
    if not found:
        return []
    docs, overlap = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
    if len(long):
        overlap = overlap + lists.holds(long, docs)
    return docs[(den + num) * overlap >= num * (n + sizes[docs])].tolist()


def _load(members: DataFrame, docs: DataFrame, n: int, lower: bool) -> DataFrame:
    """(node, ngrams) of members(doc_id, node, h1, h2), read again from the text of one document of each."""
    h = "h1 long, h2 long, "

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = {}
            for h1, h2, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), ngram_sets(b.column(0), n, lower), strict=True):
                # rows may share an id and differ in text; without an id, a row asks for its own set
                own = set_hash(s)
                if h1 is None or own == (h1, h2):
                    told[own] = s.view(np.int64)
                if sum(map(len, told.values())) > UNIT_NGRAMS // 2:
                    yield pack(told)
                    told = {}
            yield pack(told)

    def pack(told: dict) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, told.values())], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *told.values()])))
        cols = [pa.array([k[i] for k in told], pa.int64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*cols, lists], ["g1", "g2", "ngrams"])

    known = members.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("d"), "h1", "h2")
    texts = docs.filter("doc_id IS NOT NULL").join(small_side(known, 40), F.col("doc_id") == F.col("d")).select("text", "h1", "h2")
    loose = members.filter("doc_id IS NULL")
    if loose.head(1):  # sets that only rows without an id have
        nothing = F.lit(None).cast("long")
        texts = texts.unionAll(docs.filter("doc_id IS NULL").select("text", nothing, nothing))
    sets = texts.mapInArrow(trimmed(load), h.replace("h", "g") + "ngrams array<long>")
    # equal sets of several rows or batches meet in one
    sets = sets.join(small_side(members.select("node", "h1", "h2"), 40), (F.col("g1") == F.col("h1")) & (F.col("g2") == F.col("h2")))
    return sets.select("node", "ngrams")


def _links(reach: DataFrame, classes: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) of nodes that span the links of reach(node, size, shared) inside classes(node, root)."""
    classes = scratch.save(classes.withColumnsRenamed({"node": "of", "root": "class"}), "classes")
    sets = scratch.save(reach.join(small_side(classes, 24), F.col("node") == F.col("of")).drop("of"), "cells")
    sums = sets.groupBy(F.col("class").alias("c")).agg(F.sum(F.size("shared")).alias("grams"))
    sums = scratch.save(sums.withColumn("blocks", F.ceil(F.col("grams") / CELL_NGRAMS).cast("int")), "class-sizes")
    small = sums.filter("blocks = 1").agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    bins = max(partitions(reach.sparkSession), int(small) // (CELL_NGRAMS // 4) + 1)
    dealt = sets.join(small_side(sums.drop("grams"), 24), F.col("class") == F.col("c"))
    # small classes share a cell, where sets of other classes do no harm; each block of a large class meets every other
    one = dealt.filter("blocks = 1").select(F.pmod(F.xxhash64("class"), F.lit(bins)).alias("c"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "node", "size", "shared")
    many = dealt.filter("blocks > 1").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
    many = many.withColumn("other", F.explode(others))
    many = many.select("c", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "size", "shared")

    def cell(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        shared = table.column("shared").combine_chunks()
        ends, flat = shared.offsets.to_numpy(), shared.values.to_numpy()
        sizes = table.column("size").to_numpy().astype(np.int64)
        links = search([flat[ends[i] : ends[i + 1]] for i in order.tolist()], sizes[order], num, den)
        ids = ids[order]
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return one.unionAll(many).groupBy("c", "i", "j").applyInArrow(cell, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, lower: bool = True, with_text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text); text_hash (xxhash64 of text) on demand.

    Two rows link if den * |A & B| >= num * |A | B| for their sets of word n-grams (A-Z lower-cased
    if ``lower``); fewer than n words are one n-gram. component_id is the smallest doc_id that links
    reach. A null text counts as empty; an empty set links with nothing, so its component is its own
    id. Rows with one id and different texts each take part, and links are between sets, so that each
    has the component of its own text; a null id takes part too and is never the smallest unless
    there is no other. Ties can't occur: the smallest id is one. Of a column name that an input has
    besides, nothing is read. A text of any length is hashed in blocks; its set of distinct n-grams
    has to fit in a task. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    sets = scratch.save(_sets(docs, n, lower), "hashes")
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = sets.filter("n > 0").groupBy("h1", "h2", F.col("n").alias("size")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # links are between groups of equal sets, which have a number each
    groups = scratch.save(groups.withColumn("node", F.monotonically_increasing_id()), "groups")
    found = scratch.save(_within_reach(docs, n, lower, num, den, total).distinct(), "candidates")
    members = groups.join(small_side(found, 16), F.col("h1") == F.col("h")).select(F.col("first").alias("doc_id"), "node", "h1", "h2")
    members = scratch.save(members, "members")
    loaded = scratch.save(_load(members, docs, n, lower), "sets")
    if loaded.count() > members.count():  # repeated rows
        loaded = scratch.save(loaded.dropDuplicates(["node"]), "sets-once")
    reach = scratch.save(_rarest_first(loaded, num, den), "reach")
    for name in ("candidates", "members", "sets", "sets-once"):
        scratch.drop(name)
    links = scratch.save(_links(reach, _classes(reach, num, den, scratch), num, den, scratch), "links")
    scratch.drop("reach")
    scratch.drop("cells")
    roots = components(links, scratch, "components")
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    roots = scratch.save(roots.withColumnsRenamed({"node": "linked"}), "roots")
    linked = groups.join(small_side(roots, 32), F.col("node") == F.col("linked"), "left")
    low = linked.filter("root IS NOT NULL").groupBy(F.col("root").alias("of")).agg(F.min("first").alias("low"))
    low = scratch.save(low, "lows")
    # documents alone in their group and without links need no look-up of it
    reached = linked.filter("copies > 1 OR root IS NOT NULL").join(small_side(low, 24), F.col("root") == F.col("of"), "left")
    reached = reached.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.coalesce("low", "first").alias("component_id"))
    reached = scratch.save(reached, "reached")
    out = sets.join(small_side(reached, 40), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") > 0), "left")
    told = [F.col("text_hash")] * with_text_hash
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *told)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), n=3, num=90, den=100)

"""Periodic runs of words in linear passes over Lyndon arrays; no suffix structure and no hash of words is built.

Words are ranks in an ordered alphabet. For the alphabet and for its inverse, the Lyndon array gives the
longest Lyndon word at each place: it ends before the next smaller suffix. Each run has such a word as its
period in one of the two orders (the order in which the word after the run is smaller than the one a
period before), so the pairs of a place and its next smaller suffix are all candidates there are. The
matched extension of a pair, which its comparison has found anyway, tells how far the run goes on; only
the first root of a run is then extended to the left, by less than a period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import read_table, small_batches
from .textblocks import WORD, text_array


def lyndon_pairs(s: list[int], least: int) -> list[tuple[int, int, int]]:
    """(end, period, start) of candidates: a place, and how far the text from it agrees with itself a period later.

    ``s`` ends in a symbol smaller than all others. Places are taken from right to left; of place i the
    suffixes after it are tried from one next smaller suffix to the following. Two extensions are reused
    instead of being matched again:

    - along that chain, the extension of the next pair follows from those of (i, j) and of j and its next
      smaller suffix, if they differ;
    - along a diagonal (pairs of one distance) the last matched stretch is kept: matching that comes to
      its start goes on at its end, so that no pair of places is compared twice.

    Only pairs that extend over ``least`` times their distance, less what stands left of a first root, are given.
    """
    n = len(s) - 1
    after, common = [n] * (n + 1), [0] * (n + 1)
    start, end = [n + 1] * (n + 1), [0] * (n + 1)
    out = []
    for i in range(n - 1, -1, -1):
        own, j, m = s[i], i + 1, 0
        while True:
            if m or own == s[j]:
                d, x = j - i, i + m
                known = start[d]
                if known < x < end[d]:
                    x = end[d]
                while s[x] == s[x + d]:
                    x += 1
                    if x == known:
                        x = end[d]
                m = x - i
                start[d], end[d] = i, x
                if s[x] > s[x + d]:
                    break
            elif own > s[j]:
                break
            # the suffix at i is smaller: on to the next smaller suffix of j
            k = common[j]
            j = after[j]
            while m < k:
                k = common[j]
                j = after[j]
            if m > k:
                m = k
                break
        after[i], common[i] = j, m
        if m > (least - 2) * (j - i):
            out.append((i + (j - i) + m, j - i, i))
    return out


def runs_of(ranks: list[int], min_exponent: int = 4, min_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of ranks (0 and more) with length >= max(min_length, min_exponent * period), by start, then period.

    ``min_exponent`` is 2 at least. A run has its smallest period, and neither neighbour extends it.
    """
    n, found = len(ranks), set()
    if n < max(min_length, min_exponent):
        return []
    top = max(ranks) + 1
    for s in ([r + 1 for r in ranks], [top - r for r in ranks]):
        s.append(0)
        last = None
        for to, p, i in sorted(lyndon_pairs(s, min_exponent)):
            if last == (to, p):
                continue  # a later root of the same run
            last, a = (to, p), i
            while a and s[a - 1] == s[a - 1 + p]:
                a -= 1
            if to - a >= max(min_length, min_exponent * p):
                found.add((a, to - a, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that aren't after the first period of any run."""
    out, at = [], 0
    for a, b in sorted((start + p, start + n) for start, n, p in runs):
        if b > at:
            out += words[at : max(at, a)]
            at = b
    return out + words[at:]


def periodic_runs(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",), min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """The columns ``keep``, ``runs`` (array of start, length, period, by start, then period) and ``collapsed``: the words left, joined by one space.

    A word is a longest run of characters other than space and 0x09-0x0D, numbered from 0. A null text has
    no words, no runs and an empty ``collapsed``. Each text is taken whole: time and memory grow with its
    words. Repeated rows give repeated rows, an empty table none; other columns aren't read, whatever their names.
    """
    small_batches(docs.sparkSession)
    run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(raw: bytes) -> tuple[list[dict], bytes]:
        words = raw.split()
        ranks = pc.rank(pa.array(words, pa.binary()), tiebreaker="dense").to_pylist() if len(words) >= min_length else []
        runs = runs_of(ranks, min_exponent, min_length)
        return [{"start": a, "length": n, "period": p} for a, n, p in runs], b" ".join(collapsed(words, runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(t) for t in text_array(b.column(b.num_columns - 1)).cast(pa.large_binary()).to_pylist()]
            runs, left = pa.array([r[0] for r in rows], pa.list_(run_kind)), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], runs, left], [*keep, "runs", "collapsed"])

    text = docs[text] if isinstance(text, str) else text
    rows = docs.select(*[docs[c] for c in keep], text.cast("string").alias("_text"))
    found = StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1] + found.fields))


def looped(doc_id: Column, text: Column) -> Column:
    """The text of the query: that of one document in ten goes on in a loop from some word on, by the checksum of its id."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    # the words are bound once, as an element of an array: the inner function would split the text again for each word
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"))), edited)[0]
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(WORD)), F.array_join(words, " ")).otherwise(text)


def greatest(runs: str) -> Column:
    """Of an array of runs, the one of the greatest length / period, then the smallest start, then period; null if there is none.

    Fractions are compared by cross products, which are exact: a text has fewer than 2^31 words.
    """

    def better(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(left != right, left > right).when(x["start"] != y["start"], x["start"] < y["start"]).otherwise(x["period"] <= y["period"])

    return F.reduce(runs, F.get(runs, F.lit(0)), lambda x, y: F.when(better(x, y), x).otherwise(y))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents. A null id has no checksum: its text isn't edited."""
    docs = read_table(spark, sf_dir, "documents")
    told = periodic_runs(docs, looped(docs["doc_id"], docs["text"].cast("string")))

    line = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), greatest("runs").alias("best"), F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period")
    return told.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

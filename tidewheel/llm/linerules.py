"""Line-first cleaning: rules are evaluated line by line, failing lines go, and a document that loses too much of its text goes with them.

A line is what stands between two line feeds; only lines with a word are judged. The first rule that a
line fails takes it out:

- navigation: at least 3 words are separators, and a fifth of its words
- symbols: more than a tenth of its characters in words are of ``[#*$%&|<>]``
- shouting: at least 4 words, and more than six tenths of its letters A-Z a-z are capitals
- filler: at least 4 words, and more than half of them repeat the word before
- unpunctuated: no word ends in a mark that ends a sentence or clause
- boilerplate: at most 25 words, and one of the stock phrases of web pages
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table, small_batches
from .textblocks import text_array

# fixed values
SEPARATORS = ("|", ">", "»", "›", "·", "•")
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies",
    "enable javascript", "skip to content", "back to top", "click here", "read more", "sign in", "sign up", "log in",
    "subscribe to", "follow us", "share this", "powered by", "lorem ipsum",
)
CLOSERS = "\"'”’»)\\]"
#: Named as in the result: the number of lines that each rule took out.
RULES = ("navigation", "symbols", "shouting", "filler", "unpunctuated", "boilerplate")

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_ENDED = re.compile(f"(?:[.!?:;]|…)(?:{'|'.join(re.escape(c) for c in CLOSERS.replace(chr(92), ''))})*(?:[\\x20\\x09-\\x0D]|\\Z)|。|！|？".encode())
_PHRASE = re.compile("|".join(PHRASES).encode(), re.IGNORECASE)


@dataclass(frozen=True)
class Limits:
    """Percentages are of words for repeats, of characters in words for lost text."""

    min_words: int = 20
    window: int = 8
    most_repeated: int = 30
    most_lost: int = 40


def failed_rule(line: bytes, words: list[bytes], n_chars: int) -> int:
    """The place in RULES of the first rule that a line fails, or -1. ``n_chars`` are its code points in words."""
    n = len(words)
    bars = sum(map(_SEPARATORS.__contains__, words))
    if bars >= 3 and 5 * bars >= n:
        return 0
    if 10 * (len(line) - len(line.translate(None, _SYMBOLS))) > n_chars:
        return 1
    if n >= 4:
        upper, letters = len(line) - len(line.translate(None, _UPPER)), len(line) - len(line.translate(None, _LETTERS))
        if 10 * upper > 6 * letters:
            return 2
        if 2 * sum(map(operator.eq, words[1:], words)) > n:
            return 3
    if not _ENDED.search(line):
        return 4
    if n <= 25 and _PHRASE.search(line):
        return 5
    return -1


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` words that are found twice or more among ``words``.

    Equal hashes of windows only tell that a text may have any; then windows are named exactly, those of
    twice the length by pairs of names, so that no two different windows count as equal.
    """
    if len(words) <= window:
        return 0
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    key = np.zeros(len(ids) - window + 1, dtype=np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(key)].astype(np.uint64) + np.uint64(1)
    key.sort()
    if not (key[1:] == key[:-1]).any():
        return 0
    names, size = ids, 1
    while size < window:
        step = min(size, window - size)
        base = int(names.max()) + 1
        names = np.unique(names[: len(names) - step] * base + names[step:], return_inverse=True)[1].astype(np.int64)
        size += step
    found = np.flatnonzero(np.bincount(names)[names] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def judged(text: bytes, limits: Limits) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, lines taken out by rule, the text of the other lines)."""
    words = text.split()
    word_chars = len(text.translate(None, _SPACE + _CONTINUED))
    kept, seen, told, lost, repeats = [], set(), [0] * len(RULES), 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            repeats += line in seen
            seen.add(line)
            n_chars = len(line.translate(None, _SPACE + _CONTINUED))
            rule = failed_rule(line, own, n_chars)
            if rule >= 0:
                told[rule] += 1
                lost += n_chars
                continue
        kept.append(line)
    return len(words), word_chars, len(text) - len(text.translate(None, _SYMBOLS)), repeats, repeated_words(words, limits.window), lost, *told, b"\n".join(kept)


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", *RULES)


def clean_documents(docs: DataFrame, limits: Limits = Limits(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per row of ``docs``: the columns ``keep``, counts of its text, lines taken out by each rule, ``cleaned`` (its other lines), base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``most_repeated`` per cent of them repeat.
    kept: not so, and the lines taken out have at most ``most_lost`` per cent of the characters in words.
    A null text counts as empty and isn't kept; blank lines stay in ``cleaned``. Texts are taken whole,
    one after another, whatever their length; repeated rows give repeated rows and an empty table none.
    Columns that aren't named in ``keep`` aren't read, whatever their names.
    """
    small_batches(docs.sparkSession)
    fields = [pa.field(n, pa.int64()) for n in _NUMBERS] + [pa.field("cleaned", pa.string())]

    def run(texts: pa.Array) -> pa.Array:
        rows = [judged(t, limits) for t in text_array(texts).cast(pa.large_binary()).to_pylist()]
        cols = list(zip(*rows, strict=True)) or [()] * len(fields)
        arrays = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(arrays, fields=fields)

    kind = ", ".join(f"{n}: bigint" for n in _NUMBERS)
    told = docs.select(*[docs[c] for c in keep], F.arrow_udf(run, f"struct<{kind}, cleaned: string>")(docs[text].cast("string")).alias("_told"))
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.most_repeated * F.col("n_words"))
    told = told.select(*keep, *[F.col("_told")[n].alias(n) for n in (*_NUMBERS, "cleaned")]).withColumn("base_failed", failed)
    return told.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= limits.most_lost * F.col("word_chars")))


def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; ``cleaned_sha256`` is of the text that the line rules leave."""
    told = clean_documents(read_table(spark, sf_dir, "documents"))
    return told.select("doc_id", *_NUMBERS, "base_failed", "kept", F.sha2("cleaned", 256).alias("cleaned_sha256"))


_W = r"[^\x20\x09-\x0D]+"
OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, generate_subscripts(string_split(t, chr(10)), 1) AS k, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT r, k, line, regexp_extract_all(line, '{_W}') AS ws, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS up,
  length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters FROM l),
j AS (SELECT r, k, line, n, len(ws) > 0 AS told, CASE WHEN len(ws) = 0 THEN NULL
  WHEN len(list_filter(ws, lambda w: w IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) >= greatest(3, len(ws) / 5.0) THEN 'navigation'
  WHEN 10 * sym > n THEN 'symbols' WHEN len(ws) >= 4 AND 10 * up > 6 * letters THEN 'shouting'
  WHEN len(ws) >= 4 AND 2 * len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) > len(ws) THEN 'filler'
  WHEN NOT regexp_matches(line, '[.!?:;…]["''”’»)\]]*([\x20\x09-\x0D]|$)|[。！？]') THEN 'unpunctuated'
  WHEN len(ws) <= 25 AND regexp_matches(line, '(?i){"|".join(PHRASES)}') THEN 'boilerplate' END AS rule FROM m),
s AS (SELECT r, coalesce(sum(n), 0)::BIGINT AS word_chars, (count(*) FILTER (told) - count(DISTINCT line) FILTER (told))::BIGINT AS n_dup_lines,
  coalesce(sum(n) FILTER (rule IS NOT NULL), 0)::BIGINT AS lost_chars,
  {", ".join(f"(count(*) FILTER (rule = '{x}'))::BIGINT AS {x}" for x in RULES)},
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (rule IS NULL), '')) AS cleaned_sha256 FROM j GROUP BY r),
w AS (SELECT r, ws, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '{_W}') AS ws FROM d)),
g AS (SELECT r, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(list_slice(ws, i, i + 7), ' ') END AS gram FROM w),
f AS (SELECT r, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g),
c AS (SELECT r, i, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM f),
q AS (SELECT r, count(*)::BIGINT AS n_words, (count(*) FILTER (inside))::BIGINT AS n_repeat_words FROM c GROUP BY r),
o AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost_chars, {", ".join(RULES)}, cleaned_sha256 FROM d JOIN s USING (r) LEFT JOIN q USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost_chars <= 40 * word_chars AS kept FROM o
"""

"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised, cut before each run of the space mark, and each segment is merged on its own:
an agenda of adjacent symbol pairs, best score first and leftmost among equals, until no pair
forms a piece. No piece has the space mark after another character (checked when the vocabulary is
read), so no merge crosses a cut and the segments' ids joined are the text's ids. Every segment
that is merged here is also encoded and decoded by the sentencepiece library, an Arrow batch at a
time, and a difference is an error. Segments seen before are looked up in a cache of bounded size.
Where the normaliser changes more than spaces, whole texts are compared, each of them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .scratch import KEPT, read_table, small_batches, trimmed

MARK = "▁"
#: Segments of a generation of the cache; two are kept.
CACHE = 300_000
#: Texts are cut in blocks of at most so many characters (or one text), so that the lists of segments stay small.
BLOCK_CHARS = 1 << 20
#: Segments over this length aren't kept in the cache.
LONG = 64


class Vocabulary:
    """Pieces, scores and the agenda of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.byte_ids = {}
        self.rank, self.ids, self.bytes_of = {}, {}, []
        plain = []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i):
                self.bytes_of.append(b"")
            elif m.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                plain.append((piece, m.get_score(i), i))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        # spaces stand for the mark from here on: most segments then take a byte for each character
        for piece, score, i in plain:
            self.ids[piece.replace(MARK, " ")] = i
            self.rank[piece.replace(MARK, " ")] = -score
        if len(self.ids) < len(plain) or any(" " in p for p, _, _ in plain) or " " in m.normalize("a b"):
            raise ValueError("spaces aren't marked: a mark and a space would be told as one")
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece holds a space after another character: segments would depend on each other")
        self.unknown = m.unk_id()
        self.told = [str(i).encode() for i in range(n)]
        self.cut = re.compile(" *[^ ]+| +")
        # ids as text of each segment; with the decoded text, only where that isn't the segment itself
        self.seen: dict[str, bytes | tuple[bytes, bytes]] = {}
        self.older: dict[str, bytes | tuple[bytes, bytes]] = {}
        self.most = CACHE
        # What this model's normaliser does besides marking spaces; most merge models do nothing else.
        self.prefix = m.normalize("a").startswith(MARK)
        probe = "Aﬁ ÅÅ  é\t\nＡ x "
        self.plain_text = m.normalize(probe) == (MARK if self.prefix else "") + probe.replace(" ", MARK)

    def hold(self, most: int) -> None:
        """From now on a generation of the cache has ``most`` segments; a cache with more than two of them is emptied."""
        self.most = most
        if len(self.seen) + len(self.older) > 2 * most:
            self.seen, self.older = {}, {}

    def normalise(self, text: str) -> str:
        """The library's normal text, with spaces for its marks."""
        if not text:
            return ""
        if not self.plain_text or "\0" in text:
            return self.library.normalize(text).replace(MARK, " ")
        return (" " if self.prefix else "") + text.replace(MARK, " ")

    def merge(self, segment: str) -> list[int]:
        """Ids of a normalised segment by a score-ordered agenda of adjacent symbol pairs."""
        rank = self.rank
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(rank[pair], i, pair) for i in range(n - 1) if (pair := segment[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            a = symbols[i]
            if a is None or (j := right[i]) >= n or a + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heapq.heappush(agenda, (rank[new], i, new))
            if (h := left[i]) >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heapq.heappush(agenda, (rank[new], h, new))
        ids = []
        for s in symbols:
            if s is None:
                continue
            if (i := self.ids.get(s)) is not None:
                ids.append(i)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in s.replace(" ", MARK).encode()]
            else:
                ids.append(self.unknown)
        return ids

    def _learn(self, segments: list[str]) -> dict[str, bytes | tuple[bytes, bytes]]:
        """Encodes segments, checks them against the library in one call, and returns their ids as text, (ids as text, decoded) where they decode to another text."""
        made = [self.merge(s) for s in segments]
        if self.prefix:
            # the library puts its own space mark in front of what it is given
            asked = [s[1:] if s[0] == " " else None for s in segments]
        else:
            asked = segments
        known = [(a, ids) for a, ids in zip(asked, made, strict=True) if a and self.plain_text]
        theirs = self.library.encode([a for a, _ in known], num_threads=1)
        for (a, ids), own in zip(known, theirs, strict=True):
            if ids != own:
                raise ValueError(f"the agenda and the sentencepiece library differ on {a[:80]!r}: {ids[:20]} and {own[:20]}")
        # segments one after another are a text, too: one call decodes them all
        flat = [i for ids in made for i in ids]
        self._same_text(flat, self.decode(flat), self.library.decode(flat) if flat else "")
        of, told, out = self.bytes_of, self.told, {}
        for s, ids in zip(segments, made, strict=True):
            x, text = b",".join([told[i] for i in ids]), b"".join([of[i] for i in ids])
            out[s] = x if text == s.encode() else (x, text)
        return out

    @staticmethod
    def _same_text(ids: list[int], own: str, theirs: str) -> None:
        if own != theirs:
            at = next((i for i, (x, y) in enumerate(zip(own, theirs, strict=False)) if x != y), 0)
            raise ValueError(f"the own decoding and the sentencepiece library's differ: {own[at : at + 80]!r} and {theirs[at : at + 80]!r}")

    def _compare(self, text: str, told: bytes, decoded: bytes) -> None:
        """Checks a whole text's ids and decoding against the library."""
        ids, theirs = [int(x) for x in told.split(b",")] if told else [], self.library.encode(text)
        if ids != theirs:
            raise ValueError(f"the agenda and the sentencepiece library differ on {text[:80]!r}: {ids[:20]} and {theirs[:20]}")
        self._same_text(ids, decoded.decode("utf-8", "replace"), self.library.decode(ids))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, bytes, bytes]]:
        """(number of ids, ids in decimal joined by commas, decoded text in UTF-8) of each text."""
        normal = [self.normalise(t) for t in texts]
        cuts = [self.cut.findall(t) for t in normal]
        need = set().union(*cuts) if cuts else set()
        get, older = self.seen, self.older
        found, new = {}, []
        for s in need:
            x = get.get(s)
            if x is None and (x := older.get(s)) is not None:
                get[s] = x
            if x is None:
                new.append(s)
            else:
                found[s] = x
        learned = self._learn(new)
        found |= learned
        for s, x in learned.items():
            if len(s) <= LONG:
                get[s] = x
        if len(get) > self.most:
            self.older, self.seen = get, {}
        odd = {s: x for s, x in found.items() if type(x) is tuple}
        found |= {s: x for s, (x, _) in odd.items()}
        out = []
        for whole, own in zip(normal, cuts, strict=True):
            ids = b",".join([found[s] for s in own])
            if odd and not odd.keys().isdisjoint(own):
                text = b"".join([odd[s][1] if s in odd else s.encode() for s in own])
            else:
                text = whole.encode()
            if self.prefix and text[:1] == b" ":
                text = text[1:]
            out.append((ids.count(b",") + 1 if ids else 0, ids, text))
        if not self.plain_text:
            for t, (_, ids, text) in zip(texts, out, strict=True):
                self._compare(t, ids, text)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: pieces and bytes joined, invalid UTF-8 replaced, without the space put in front."""
        text = b"".join([self.bytes_of[i] for i in ids])
        if self.prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


KEPT["sentencepieces"] = vocabulary.cache_clear


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def text_blocks(texts: list[str | None], most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        t = t or ""
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False, with_text: bool = False, cache: int = CACHE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs(doc_id, text); ids (array<int>) and decoded on demand.

    A null or empty text has no ids and decodes to the empty text. Repeated rows give repeated
    rows, an empty table gives none, other columns are ignored. Nothing is shuffled; a task holds one
    Arrow batch, blocks of about ``block_chars`` characters and a cache of bounded size, which
    a worker keeps until a task of another operator. ``model`` is a path that every machine can open;
    ``cache`` is the number of segments in each of the cache's two generations: with fewer, more are merged anew.
    """
    path = model or default_model()
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        v.hold(cache)
        for batch in batches:
            for i, block in enumerate_blocks(batch.column(1), block_chars):
                told = v.encode_batch(block)
                cols = [batch.column(0).slice(i, len(block)), pa.array([n for n, _, _ in told], pa.int64())]
                cols += [pa.array([hashlib.sha256(t[k]).hexdigest() for t in told], pa.string()) for k in (1, 2)]
                if with_ids:
                    flat = np.fromstring(b",".join([ids for _, ids, _ in told if ids]), dtype=np.int32, sep=",")
                    ends = np.cumsum([0, *(n for n, _, _ in told)], dtype=np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                if with_text:
                    cols.append(pa.array([text.decode("utf-8", "replace") for _, _, text in told], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids + ["decoded"] * with_text
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(trimmed(run, keeps="sentencepieces"), schema)


def enumerate_blocks(column: pa.Array, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of blocks of an Arrow column."""
    at = 0
    for start in range(0, len(column), 256):
        for block in text_blocks(column.slice(start, 256).to_pylist(), most):
            yield at, block
            at += len(block)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))

"""WARC archives with a two-level capture index.

Records are gzip members of archive files. Each gives an index line under a key: the URL with its
host reversed, then the page id. Lines are sorted by key over all archives and written as shards
of compressed blocks; a shard ends with its sparse directory, the first key of each block. A look-up
finds the shard, the block and the line by binary search and reads that range of the archive only.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, partitions, read_table, small_side

BLOCK_LINES = 500
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n"
#: Spaces, control characters and line separators.
_UNSAFE = re.compile("[\x00-\x20\x7f-\xa0\u2028\u2029]")


def reversed_host(url: str | None) -> str:
    """``com,example,www)/path?query`` of a URL, without scheme, user and fragment; ``-`` for null.

    Spaces and control characters are escaped in every case, a URL that isn't one included, so that a
    key is one field of one line. Keys needn't tell URLs apart: the page id that follows does.
    """
    if url is None:
        return "-"
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port else ""
        url = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        pass
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def key_of(url: str | None, page_id: int | None) -> str:
    return f"{reversed_host(url)} {'-' if page_id is None else page_id}"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP head of its payload and not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'-' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {json.dumps(refers_url)[1:-1]}")
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END * 2 + block + _END * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(_END * 2)
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(_END * 2)[2]


def _id(urn: str) -> int | None:
    told = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if told == "-" else int(told)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, name: str):
    """An output file in the shared folder, named for this attempt of the task: a second attempt writes another."""
    task = TaskContext.get()
    uri = f"{folder}/{name}-{task.partitionId():05d}-{task.taskAttemptId()}.gz"
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, system.open_output_stream(path, compression=None)


def write_archives(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html, digest, refers_to, refers_url); returns index lines key, file, start, length."""
    folder = f"{scratch.root}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                lines = []
                for page_id, url, html, digest, is_revisit, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if out is None:
                        uri, out = _writer(folder, "pages.warc")
                    kind = "revisit" if is_revisit else "response"
                    data = gzip.compress(record(kind, page_id, url, (html or "").encode(), digest, refers_to, refers_url), 6, mtime=0)
                    out.write(data)
                    lines.append((key_of(url, page_id), uri, at, len(data)))
                    at += len(data)
                if lines:
                    cols = zip(*lines, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["key", "file", "start", "length"])
        if out is not None:
            out.close()

    cols = pages.select("page_id", "url", "html", "digest", "is_revisit", "refers_to", "refers_url")
    # the table is what commits a task's archive: lines of failed attempts never get there
    return scratch.save(cols.mapInArrow(run, "key string, file string, start long, length long"), "lines")


def write_index(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Sorts lines by key into shards of compressed blocks; returns one row for each shard: first, file, directory_start, directory_length."""
    folder, names = f"{scratch.root}/index", ["first", "file", "directory_start", "directory_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at, held, directory = None, "", 0, [], []

        def flush():
            nonlocal at
            data = zlib.compress("\n".join("\t".join(x) for x in held).encode(), 6)
            out.write(data)
            directory.append((held[0][0], at, len(data)))
            at += len(data)
            held.clear()

        for batch in batches:
            for key, file, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    uri, out = _writer(folder, "captures")
                held.append((key, file, str(start), str(length)))
                if len(held) == BLOCK_LINES:
                    flush()
        if out is None:
            return
        if held:
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data)
        out.close()
        row = ([directory[0][0]], [uri], [at], [len(data)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names)

    spark = lines.sparkSession
    # Spark orders strings by their bytes; ties (one key in several archives) stay beside each other
    ranged = lines.repartitionByRange(partitions(spark), "key", "file", "start").sortWithinPartitions("key", "file", "start")
    return scratch.save(ranged.mapInArrow(run, "first string, file string, directory_start long, directory_length long"), "shards")


class CaptureIndex:
    """Look-ups in the shards; keeps the blocks and directories it used last."""

    def __init__(self, shards: list[tuple[str, str, int, int]], kept: int = 16):
        self.shards = sorted((first.encode(), file, start, length) for first, file, start, length in shards)
        self.firsts = [s[0] for s in self.shards]
        self.kept, self.cache, self.files = kept, OrderedDict(), OrderedDict()

    def _range(self, uri: str, start: int, length: int) -> bytes:
        f = self.files.pop(uri, None)
        if f is None:
            system, path = _open(uri)
            f = system.open_input_file(path)
        self.files[uri] = f
        if len(self.files) > self.kept:
            self.files.popitem(last=False)[1].close()
        return f.read_at(length, start)

    def _cached(self, what: tuple, make):
        x = self.cache.pop(what, None)
        if x is None:
            x = make()
        self.cache[what] = x
        if len(self.cache) > self.kept:
            self.cache.popitem(last=False)
        return x

    def _directory(self, s: int) -> tuple[list[bytes], list]:
        _, file, start, length = self.shards[s]

        def make():
            rows = json.loads(zlib.decompress(self._range(file, start, length)))
            return [r[0].encode() for r in rows], rows

        return self._cached(("directory", s), make)

    def _block(self, s: int, b: int) -> tuple[list[bytes], list[list[str]]]:
        _, start, length = self._directory(s)[1][b]

        def make():
            rows = [x.split("\t") for x in zlib.decompress(self._range(self.shards[s][1], start, length)).decode().split("\n")]
            return [r[0].encode() for r in rows], rows

        return self._cached(("block", s, b), make)

    def find(self, key: str) -> list[list[str]]:
        """Lines of a key: key, file, start, length."""
        told, found = key.encode(), []
        # equal keys may begin in the block or shard before the first that starts with the key
        s = max(0, bisect.bisect_left(self.firsts, told) - 1)
        while s < len(self.shards) and self.firsts[s] <= told:
            firsts, _ = self._directory(s)
            b = max(0, bisect.bisect_left(firsts, told) - 1)
            while b < len(firsts) and firsts[b] <= told:
                keys, rows = self._block(s, b)
                found += rows[bisect.bisect_left(keys, told) : bisect.bisect_right(keys, told)]
                b += 1
            s += 1
        return found

    def read(self, line: list[str]) -> tuple[dict[str, str], bytes]:
        return parse(gzip.decompress(self._range(line[1], int(line[2]), int(line[3]))))

    def payload(self, headers: dict[str, str], body: bytes) -> bytes:
        """The payload of a record; of a revisit, that of the record it refers to."""
        if headers["WARC-Type"] != "revisit":
            return body
        url = headers.get("WARC-Refers-To-Target-URI")
        key = key_of(None if url is None else json.loads(f'"{url}"'), _id(headers["WARC-Refers-To"]))

        def make():
            for line in self.find(key):
                h, b = self.read(line)
                if h["WARC-Type"] == "response" and h["WARC-Payload-Digest"] == headers["WARC-Payload-Digest"]:
                    return b
            raise ValueError(f"no response for the revisit {headers['WARC-Record-ID']} under {key}")

        return self._cached(("payload", key), make)


def read_back(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Looks up keys(key) in the index and reads their records. The top directory, a row for each shard, goes to every task."""
    top = [tuple(r) for r in shards.collect()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(top)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for line in index.find(key):
                    headers, body = index.read(line)
                    payload = index.payload(headers, body)
                    digest = hashlib.sha256(payload).hexdigest()
                    if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} has another digest than its record tells")
                    refers = headers.get("WARC-Refers-To")
                    rows.append((_id(headers["WARC-Record-ID"]), len(payload), digest, headers["WARC-Type"], None if refers is None else _id(refers)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    spark = keys.sparkSession
    sorted_keys = keys.distinct().repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    return sorted_keys.mapInArrow(run, schema)


def checked(found: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """The records read back, once as many were found as were written."""
    found = scratch.save(found, "found")
    written, read = lines.count(), found.count()
    if written != read:
        raise ValueError(f"{written} records were written and {read} were read back")
    return found


def page_keys(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [key_of(u, i) for i, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])

    return pages.select(pages["page_id"].cast("long"), "url").mapInArrow(run, "key string")


def archive(pages: DataFrame) -> DataFrame:
    """Writes archives and index of pages(page_id, url, html) and reads every record back through the index.

    Of equal payloads of at least 100 bytes, rows with the smallest page_id are responses (all of
    them, if rows repeat) and others revisits. A null html is an empty payload; a null url and a
    null page_id have the key part ``-``, and a null page_id isn't the smallest unless all are null.
    Any characters may be in a url. An empty table gives an empty result; other columns are ignored. It is
    an error if not as many records come back as were written. Payloads aren't shuffled unless
    the table of repeated payloads is too large to broadcast.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.filter(F.octet_length("html") >= LEAST_BYTES)
    repeated = large.groupBy(F.col("digest").alias("d")).agg(F.count("*").alias("n"), F.min_by("url", "page_id").alias("first_url"), F.min("page_id").alias("first"))
    repeated = scratch.save(repeated.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "repeated")
    told = rows.join(small_side(repeated, 128, F.octet_length("first_url")), F.col("digest") == F.col("d"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    told = told.select("page_id", "url", "html", "digest", revisit.alias("is_revisit"), F.when(revisit, F.col("first")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url"))
    lines = write_archives(told, scratch)
    return checked(read_back(page_keys(pages), write_index(lines, scratch)), lines, scratch)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(read_table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

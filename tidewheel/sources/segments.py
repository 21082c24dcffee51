"""A source and sink of one's own: a table as segments, files of Arrow batches, listed with the extent of each column by one manifest for each commit.

    rows.write.format("segments").mode("append").save(folder)
    spark.read.format("segments").load(folder).filter("value > 10")
    spark.readStream.format("segments").load(folder)

Batch reads need ``spark.sql.python.filterPushdown.enabled`` set to true, or Spark refuses a source that takes filters.
Tasks write segments, and only the manifest of a commit makes them part of the table: an aborted write
deletes its segments and leaves nothing. Readers take a task for each segment, skip segments whose extent no
row can pass the pushed filters with, and filter the batches of the others. A stream's offset is the number
of manifests read. Folders are URIs that ``pyarrow.fs`` opens: file, hdfs, viewfs with libhdfs, s3 (s3a is taken as s3), gs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Rows of a batch in a segment, and of a segment.
BATCH_ROWS, SEGMENT_ROWS = 8192, 1 << 20
_TESTS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def opened(folder: str):
    """(file system, path) of a folder's URI; a path without a scheme is a local file's."""
    from pyarrow import fs

    folder = "s3" + folder[3:] if folder.startswith("s3a:") else folder
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def manifests(folder: str) -> list[dict]:
    """All commits, in order."""
    from pyarrow import fs

    store, path = opened(folder)
    found = store.get_file_info(fs.FileSelector(f"{path}/_commits", allow_not_found=True))
    out = []
    for f in sorted((f for f in found if f.path.endswith(".json")), key=lambda f: f.path):
        with store.open_input_stream(f.path) as file:
            out.append(json.loads(file.read()))
    return out


@dataclass
class Segment(InputPartition):
    path: str
    extents: dict


@dataclass
class Written(WriterCommitMessage):
    segments: list


def _extent(column: pa.ChunkedArray | pa.Array) -> list | None:
    """Smallest and largest value as numbers (times in microseconds) or texts; None where the type has no order here, or where NaN is among them."""
    kind = column.type
    if pa.types.is_floating(kind) and pc.any(pc.is_nan(column)).as_py():
        return None
    if pa.types.is_timestamp(kind):
        column = column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64())
    elif not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind)):
        return None
    ends = pc.min_max(column).as_py()
    return [ends["min"], ends["max"]]


def may_hold(extents: dict, f) -> bool:
    """Whether a segment with these extents can have a row that passes a filter of ``_TESTS``."""
    ends = extents.get(f.attribute[0])
    if ends is None or isinstance(f.value, str) != isinstance(ends[0], str) or not isinstance(f.value, (int, float, str)):
        return True
    low, high = ends
    return {EqualTo: low <= f.value <= high, GreaterThan: high > f.value, GreaterThanOrEqual: high >= f.value, LessThan: low < f.value, LessThanOrEqual: low <= f.value}[type(f)]


def _read(segment: Segment, filters: list, columns: list[str]) -> Iterator[pa.RecordBatch]:
    store, path = opened(segment.path)
    with store.open_input_stream(path) as file, pa.ipc.open_stream(file) as batches:
        for b in batches:
            for f in filters:
                column = b.column(f.attribute[0])
                passed = _TESTS[type(f)](column, pa.scalar(f.value, column.type))
                if pa.types.is_floating(column.type) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    passed = pc.or_(passed, pc.is_nan(column))  # as Spark has it, NaN is larger than any number
                b = b.filter(pc.fill_null(passed, False))
            yield b.select(columns)


class SegmentReader(DataSourceReader):
    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns, self.filters = folder, columns, []

    def pushFilters(self, filters):
        """Comparisons of a column with a number or text are done here; the rest goes back to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool) and f.value == f.value:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        every = [Segment(f"{self.folder}/{s['name']}", s["extents"]) for m in manifests(self.folder) for s in m["segments"]]
        return [s for s in every if all(may_hold(s.extents, f) for f in self.filters)]

    def read(self, partition):
        if partition is not None:
            yield from _read(partition, self.filters, self.columns)


class SegmentStream(DataSourceStreamReader):
    """Offsets count commits; a batch has the segments of those between two offsets."""

    def __init__(self, folder: str, columns: list[str]):
        self.folder, self.columns = folder, columns

    def initialOffset(self):
        return {"commits": 0}

    def latestOffset(self):
        return {"commits": len(manifests(self.folder))}

    def partitions(self, start, end):
        return [Segment(f"{self.folder}/{s['name']}", {}) for m in manifests(self.folder)[start["commits"] : end["commits"]] for s in m["segments"]]

    def read(self, partition):
        return _read(partition, [], self.columns)

    def commit(self, end):
        pass


class SegmentWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.write_id = folder, overwrite, uuid.uuid4().hex
        store, path = opened(folder)
        store.create_dir(f"{path}/{self.write_id}", recursive=True)

    def write(self, iterator):
        """Rows of a task into segments, a batch at a time; extents are kept up with. The folder is there until an abort, so a task that is late finds none to write to."""
        store, path = opened(self.folder)
        out, sink, n = [], None, 0
        try:
            for b in iterator:
                for at in range(0, b.num_rows, BATCH_ROWS):
                    part = b.slice(at, BATCH_ROWS)
                    if sink is None:
                        name = f"{self.write_id}/{uuid.uuid4().hex}.arrow"
                        file = store.open_output_stream(f"{path}/{name}")
                        sink, n = pa.ipc.new_stream(file, part.schema), 0
                        out.append({"name": name, "rows": 0, "extents": {}})
                    sink.write_batch(part)
                    n += part.num_rows
                    last = out[-1]
                    for field, column in zip(part.schema, part.columns, strict=True):
                        if column.null_count == len(column):
                            continue
                        ends = _extent(column)
                        was = last["extents"].get(field.name, ends)
                        last["extents"][field.name] = None if ends is None or was is None else [min(was[0], ends[0]), max(was[1], ends[1])]
                    last["rows"] = n
                    if n >= SEGMENT_ROWS:
                        sink.close()
                        file.close()
                        sink = None
        finally:
            if sink is not None:
                sink.close()
                file.close()
        return Written(out)

    def commit(self, messages):
        store, path = opened(self.folder)
        store.create_dir(f"{path}/_commits", recursive=True)
        old = manifests(self.folder)
        number = 0 if self.overwrite else len(old)
        if self.overwrite:
            store.delete_dir_contents(f"{path}/_commits")
        name = f"{path}/_commits/{number:012d}-{self.write_id}"
        with store.open_output_stream(f"{name}.tmp") as file:
            file.write(json.dumps({"segments": [s for m in messages if m for s in m.segments]}).encode())
        store.move(f"{name}.tmp", f"{name}.json")  # readers see a commit whole or not at all
        if self.overwrite:
            for folder in {s["name"].split("/")[0] for m in old for s in m["segments"]}:
                store.delete_dir(f"{path}/{folder}")

    def abort(self, messages):
        store, path = opened(self.folder)
        store.delete_dir(f"{path}/{self.write_id}")


class Segments(DataSource):
    """``path`` names the folder; the schema is that of the first segment, or the one given."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        for m in manifests(self.options["path"]):
            for s in m["segments"]:
                store, path = opened(f"{self.options['path']}/{s['name']}")
                with store.open_input_stream(path) as file, pa.ipc.open_stream(file) as batches:
                    return from_arrow_schema(batches.schema, prefer_timestamp_ntz=True)
        raise ValueError(f"no segments in {self.options['path']}: give a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return SegmentReader(self.options["path"], schema.names)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SegmentStream(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SegmentWriter(self.options["path"], overwrite)

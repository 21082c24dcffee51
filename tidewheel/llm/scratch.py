"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count of its rows shows at most this many bytes.
BROADCAST_BYTES = 48 << 20
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this process only where that is unset and all tasks run in this process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tidewheel-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> SparkSession:
    """Sessions that don't set the size of Arrow's batches get a smaller one: a batch and its copies in the JVM and in Python then take some megabytes."""
    for key, own in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(own))
    return spark


#: What a worker keeps from task to task: functions that let go of it, by the operator that keeps it.
KEPT: dict[str, Callable[[], None]] = {}


def let_go(but: str = "") -> None:
    """Empties what other operators than ``but`` keep in this worker."""
    for name, empty in KEPT.items():
        if name != but:
            empty()


def trimmed(run, keeps: str = ""):
    """A function of batches that, at the end of a task, gives the memory that the worker has freed back to the machine: workers stay for the tasks of later stages.

    What other operators than ``keeps`` have kept in the worker goes before the task begins."""

    @functools.wraps(run)
    def told(batches):
        import ctypes

        import pyarrow as pa

        let_go(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return told


class Scratch:
    """Named tables of one run of an operator, written as Parquet so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, row_bytes: int, *more: Column) -> DataFrame:
    """``df`` with a broadcast hint if its rows are counted to fit in BROADCAST_BYTES, else as it is (a shuffled join).

    ``row_bytes`` is for the columns of fixed size; ``more`` are columns with the bytes of the others.
    """
    each = sum((F.coalesce(c.cast("long"), F.lit(0)) for c in more), F.lit(row_bytes).cast("long"))
    size = df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small fixed table as one literal: unlike createDataFrame, no RDD and no Python worker has a part in it."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    values = F.array(*[F.struct(*[F.lit(v).alias(name) for (name, _), v in zip(fields, row, strict=True)]) for row in rows])
    kind = ",".join(f"{name}:{of}" for name, of in fields)
    return spark.range(1).select(F.inline(values.cast(f"array<struct<{kind}>>")))

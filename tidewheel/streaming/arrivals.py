"""``events`` as files that arrive one wave after another, each read by a run of the stream that goes on where the last one ended."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.registry import table

#: Waves in which the events arrive.
WAVES = 4


def waves(rows: DataFrame, n: int = WAVES, held_back=None) -> DataFrame:
    """``rows`` with ``wave``: the part of the whole time that ``ts`` is in, of n equal ones; rows where ``held_back`` holds come one wave later, but for the last."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = rows.agg(F.min(us).alias("a"), F.max(us).alias("b")).first()
    if ends["a"] is None:
        return rows.withColumn("wave", F.lit(0))
    # in whole numbers: a quotient in floating point could round up at the end of a wave
    wave = F.expr(f"cast(({n} * (unix_micros(cast(ts as timestamp)) - {ends['a']}L)) div {ends['b'] - ends['a'] + 1}L as int)")
    if held_back is not None:
        wave = F.when(held_back, F.least(wave + 1, F.lit(n - 1))).otherwise(wave)
    return rows.withColumn("wave", wave)


#: Keeps the state of streams in RocksDB, which timers and times to live need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Streams that run on the clock would else run batches without data for ever.
DATA_ONLY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """What is started inside has ``conf``; the session gets its own settings back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def each_wave(spark: SparkSession, sf_dir: str, folder: str, start, held_back=None, conf: dict[str, str] = ROCKSDB) -> None:
    """Writes the events of one wave after another into ``folder``/in; after each, ``start`` gets the stream over all of them and starts a query.

    ``start`` gives its query a checkpoint, so each run takes the files that are new, as one batch, with the state of the runs before.
    """
    rows = waves(table(spark, sf_dir, "events"), held_back=held_back)
    # all waves in one pass over the events; each then arrives as new files in the folder that the stream reads
    rows.write.partitionBy("wave").parquet(f"{folder}/all")
    kind = rows.schema
    for wave in range(WAVES):
        spark.read.schema(kind).parquet(f"{folder}/all").filter(F.col("wave") == wave).write.mode("append").parquet(f"{folder}/in")
        with settings(spark, conf):
            start(spark.readStream.schema(kind).parquet(f"{folder}/in").withColumn("ts", F.col("ts").cast("timestamp"))).awaitTermination()

"""As-of and sessions when one key has most of the rows: rows are dealt by ranges of (key, time), not by key.

Each range is gone through in order, a batch of Arrow at a time, with the last row of the batch before as
carry. What a range needs from the ranges before it is a row or two for each range; these are put in order
and joined back. So no task has more than its range, however hot a key is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder

GAP_US = 30 * 60 * 1_000_000


def _scanned(rows: DataFrame, order: list[str], run, kind: str, ranges: int | None) -> DataFrame:
    """``rows`` in ranges by ``order``, each sorted, with the number of the range as first column, through ``run``; a written table, as ranges of a second evaluation could differ."""
    spark = rows.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("pid"), "*")
    folder = new_folder(spark, "ordered")
    dealt.mapInArrow(run, kind).write.parquet(folder)
    return spark.read.parquet(folder)


def as_of(rows: DataFrame, key: str, time: str, row_id: str, asks: str, ranges: int | None = None) -> DataFrame:
    """row_id and ``prior`` of the rows where ``asks`` holds: the latest other row of the key at or before its time, or null; of ties the largest id.

    Keys, times (timestamps) and ids (integers) that are null take no part. A row with the same time as an asking one counts as before it.
    """
    on = [F.col(key).cast("long").alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.coalesce(F.expr(asks), F.lit(False)).alias("asks"), F.col(row_id).cast("long").alias("id")]
    rows = rows.select(*on).na.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_id = None, -1  # the last row that doesn't ask, of the key that goes on
        has = False
        for b in batches:
            pid, k, _, asks, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(k):
                continue
            first = np.maximum.accumulate(np.where(np.r_[True, k[1:] != k[:-1]], np.arange(len(k)), 0))
            at = np.maximum.accumulate(np.where(asks, -1, np.arange(len(k))))
            found = at >= first
            prior = np.where(found, ids[np.maximum(at, 0)], -1)
            if has and k[0] == last_key:
                from_before = ~found & (first == 0)
                prior[from_before], found = last_id, found | from_before
            has, last_key = bool((at[-1] >= first[-1]) or (has and first[-1] == 0 and k[0] == last_key)), k[-1]
            last_id = ids[at[-1]] if at[-1] >= first[-1] else last_id
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(prior, pa.int64(), mask=~found)], ["pid", "k", "t", "asks", "id", "prior"])

    told = _scanned(rows, ["k", "t", "asks", "id"], run, "pid int, k long, t long, asks boolean, id long, prior long", ranges)
    # the last row that doesn't ask before each range: a row for each range
    ends = told.groupBy("pid").agg(F.max(F.when(~F.col("asks"), F.struct("k", "t", "id"))).alias("end"))
    ends = ends.select("pid", F.max("end").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    asked = told.filter("asks").join(F.broadcast(ends), "pid", "left")
    carried = F.when(F.col("before.k") == F.col("k"), F.col("before.id"))
    return asked.select(F.col("id").alias(row_id), F.coalesce("prior", carried).alias("prior"))


def sessions(rows: DataFrame, key: str, time: str, row_id: str, gap_us: int = GAP_US, ranges: int | None = None) -> DataFrame:
    """k, session (from 1, by time), n, first_us and last_us of the sessions of each key: rows at most ``gap_us`` apart. Null keys and times take no part."""
    rows = rows.select(F.col(key).cast("long").alias("k"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(row_id).cast("long").alias("id")).na.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, time and session of the last row
        for b in batches:
            k, t = b.column(1).to_numpy(), b.column(2).to_numpy()
            if not len(k):
                continue
            new_key = np.r_[last is None or last[0] != k[0], k[1:] != k[:-1]]
            gap = np.r_[last is not None and t[0] - last[1] > gap_us, t[1:] - t[:-1] > gap_us]
            count = np.cumsum(new_key | gap)
            first = np.maximum.accumulate(np.where(new_key, np.arange(len(k)), -1))
            session = np.where(first >= 0, count - count[np.maximum(first, 0)] + 1, count + (last[2] if last else 0))
            last = k[-1], t[-1], int(session[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(session, pa.int64())], ["pid", "k", "t", "session"])

    told = _scanned(rows, ["k", "t", "id"], run, "pid int, k long, t long, session long", ranges)
    parts = told.groupBy("pid", "k", "session").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    # the first and the last key of each range: two rows for each range
    ends = told.groupBy("pid").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    edge = parts.join(F.broadcast(ends), "pid").filter((F.col("k") == F.col("low")) | (F.col("k") == F.col("high")))
    edge = edge.groupBy("pid", "k").agg(F.max("session").alias("sessions"), F.min("a").alias("a"), F.max("b").alias("b"))
    w = Window.partitionBy("k").orderBy("pid")
    edge = edge.withColumn("joined", F.coalesce((F.col("a") - F.lag("b").over(w) <= gap_us).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum("sessions").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = edge.select("pid", "k", (before - F.sum("joined").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("shift"))
    parts = parts.join(F.broadcast(shift), ["pid", "k"], "left").withColumn("session", F.col("session") + F.coalesce("shift", F.lit(0)))
    return parts.groupBy("k", "session").agg(F.sum("n").alias("n"), F.min("a").alias("first_us"), F.max("b").alias("last_us"))


def _hot(spark, sf_dir):
    """``events`` in which nine of ten are one user's."""
    return table(spark, sf_dir, "events").withColumn("user_id", F.when(F.col("event_id") % 10 == 0, F.col("user_id")).otherwise(F.lit(1).cast("long")))


_HOT_SQL = "hot AS (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN user_id ELSE 1 END AS user_id) FROM events)"


@query(f"""
WITH {_HOT_SQL} SELECT p.event_id, v.event_id AS prior FROM (SELECT * FROM hot WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM hot WHERE event_type <> 'purchase') v ON p.user_id = v.user_id AND p.ts >= v.ts
""")
def join_as_of_hot(spark, sf_dir):
    """As-of within a user who has nine tenths of the events."""
    return as_of(_hot(spark, sf_dir), "user_id", "ts", "event_id", "event_type = 'purchase'")


@query(f"""
WITH {_HOT_SQL}, marked AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM hot WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM numbered GROUP BY user_id, session
""")
def sessions_hot(spark, sf_dir):
    """Sessions of users, one of whom has nine tenths of the events."""
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    told = sessions(_hot(spark, sf_dir), "user_id", "ts", "event_id")
    return told.select(F.col("k").alias("user_id"), "session", "n", at("first_us").alias("first_ts"), at("last_us").alias("last_ts"))

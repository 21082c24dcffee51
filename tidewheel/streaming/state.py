"""State of one's own over several batches and restarts: open spells with timers, and keys seen with a time to live."""

from __future__ import annotations

import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewheel.plans.registry import query
from tidewheel.sources.folders import new_folder
from tidewheel.streaming.arrivals import DATA_ONLY, ROCKSDB, each_wave

#: A spell ends when nothing has come for so long.
GAP_US = 30 * 60 * 1_000_000
#: How long the first event of a key is remembered, by the clock.
SEEN_MS = 24 * 3600 * 1000


class Spells(StatefulProcessor):
    """The spells of a bucket's users: events less than ``gap_us`` apart, in whatever order they come within the watermark.

    State has the open spells of the bucket only, packed in one value, so that calls and values follow the buckets and
    not the users or spells: all spells of a batch are open until the watermark moves. A timer of event time is set for the first of them to end; when the watermark passes it,
    spells that no event can reach any more are given and forgotten. Events without a time belong to no spell.
    """

    def __init__(self, gap_us: int = GAP_US):
        self.gap_us = gap_us

    def init(self, handle):
        self.handle = handle
        self.open = handle.getValueState("open", "packed binary")

    def _open(self) -> list[tuple]:
        packed = self.open.get()
        return pickle.loads(bytes(packed[0])) if packed else []

    def _keep(self, spells):
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spells:
            self.open.update((pickle.dumps(spells),))
            self.handle.registerTimer(-(-(min(s[2] for s in spells) + self.gap_us) // 1000))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        spells = self._open()
        for part in rows:
            part = part[part["us"].notna()]
            us = part["us"].astype("int64").tolist()
            spells += zip(part["user_id"].tolist(), us, us, [1] * len(us), part["value"].fillna(0.0).tolist(), strict=True)
        self._keep(merged(spells, self.gap_us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        upto = timerValues.getCurrentWatermarkInMs() * 1000
        spells = self._open()
        done = [s for s in spells if s[2] + self.gap_us <= upto]
        self._keep([s for s in spells if s[2] + self.gap_us > upto])
        if done:
            yield pd.DataFrame(done, columns=["user_id", "first", "last", "n", "total"])

    def close(self):
        pass


def merged(spells: list[tuple], gap_us: int) -> list[tuple]:
    """(user, first, last, n, total) of which those of a user that are less than ``gap_us`` apart have become one."""
    out = []
    for user, first, last, n, total in sorted(spells, key=lambda s: (s[0] is not None, s[0] or "", s[1])):
        if out and out[-1][0] == user and first - out[-1][2] < gap_us:
            _, a, b, m, t = out[-1]
            out[-1] = (user, a, max(b, last), m + n, t + total)
        else:
            out.append((user, first, last, n, total))
    return out


class FirstSeen(StatefulProcessor):
    """Gives the earliest row of a user and type when they come for the first time, and again only after they were forgotten.

    State has the users and types seen of a bucket, each with the time when it was first seen, packed in one value; those past their time to live are left out.
    """

    def __init__(self, ttl_ms: int = SEEN_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.seen = handle.getValueState("seen", "packed binary", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        best = {}
        for part in rows:
            for user, kind, us, i in zip(part["user_id"], part["event_type"], part["us"].tolist(), part["event_id"].tolist(), strict=True):
                if (user, kind) not in best or (us, i) < best[user, kind]:
                    best[user, kind] = us, i
        now, packed = timerValues.getCurrentProcessingTimeInMs(), self.seen.get()
        known = {k: ms for k, ms in (pickle.loads(bytes(packed[0])) if packed else {}).items() if ms + self.ttl_ms > now}
        new = [k for k in best if k not in known]
        if new:
            self.seen.update((pickle.dumps(known | dict.fromkeys(new, now)),))
            yield pd.DataFrame([(*k, best[k][1]) for k in new], columns=["user_id", "event_type", "event_id"])

    def close(self):
        pass


#: Buckets of users that hold the state. Part of a checkpoint: a stream that goes on must have as many as before.
BUCKETS = 512


def _bucket(user, buckets: int):
    return F.pmod(F.xxhash64(user), F.lit(buckets)).alias("bucket")


def spells(stream: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """user_id, first, last (microseconds), n and total of the spells of a stream with user_id, ts and value."""
    user = F.col("user_id").cast("string")  # as text: pandas would make floats of numbers where one is null
    rows = stream.withWatermark("ts", delay).select(_bucket("user_id", buckets), user.alias("user_id"), "ts", "value", F.unix_micros("ts").alias("us"))
    told = rows.groupBy("bucket").transformWithStateInPandas(Spells(), "user_id string, first long, last long, n long, total double", "append", "EventTime")
    return told.withColumn("user_id", F.col("user_id").cast("long"))


def first_seen(stream: DataFrame, ttl_ms: int = SEEN_MS, buckets: int = BUCKETS) -> DataFrame:
    rows = stream.select(_bucket("user_id", buckets), F.col("user_id").cast("string"), "event_type", "event_id", F.unix_micros("ts").alias("us"))
    told = rows.groupBy("bucket").transformWithStateInPandas(FirstSeen(ttl_ms), "user_id string, event_type string, event_id long", "update", "ProcessingTime")
    return told.withColumn("user_id", F.col("user_id").cast("long"))


def _over_waves(spark, sf_dir, name, told, mode, conf):
    """Runs ``told`` of the stream once for each wave, into files; reads them."""
    folder = new_folder(spark, name)

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    def start(stream):
        return told(stream).writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    each_wave(spark, sf_dir, folder, start, conf=conf)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("""
WITH marked AS (SELECT user_id, ts, event_id, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS n, round(sum(value), 4) AS total
FROM numbered GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_spells(spark, sf_dir):
    """Spells that the watermark has closed; they go on over batches and restarts."""
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return _over_waves(spark, sf_dir, "spells", spells, "append", ROCKSDB).select("user_id", at("first").alias("first_ts"), at("last").alias("last_ts"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def stream_first_seen(spark, sf_dir):
    """The first event of each user and type: later batches find the key in the state, which forgets it after a day."""
    return _over_waves(spark, sf_dir, "seen", first_seen, "update", ROCKSDB | DATA_ONLY)

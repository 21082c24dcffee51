"""Queries over ``events`` as a stream of files, run until all there is has been read; append mode gives closed windows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewheel.plans.registry import query, table
from tidewheel.sources.folders import new_folder


#: How long late rows are waited for.
DELAY = "1 hour"


def _events(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/event[s].parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def _finished(stream, spark, name, mode="append"):
    """Runs a stream to its end into files, and reads them."""
    folder = new_folder(spark, name)
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}-state").option("path", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


@query("SELECT event_id, user_id, event_type, value FROM events WHERE value > 10")
def stream_files(spark, sf_dir):
    return _finished(_events(spark, sf_dir).filter("value > 10").select("event_id", "user_id", "event_type", "value"), spark, "files")


@query("""
SELECT hour, n, mean FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1)
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_tumbling(spark, sf_dir):
    told = _events(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    told = told.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "mean")
    return _finished(told, spark, "tumbling")


@query("""
WITH e AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - i * INTERVAL 30 MINUTE AS start FROM events, range(2) AS r(i))
SELECT start, count(*)::BIGINT AS n FROM e GROUP BY start HAVING start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_sliding(spark, sf_dir):
    told = _events(spark, sf_dir).withWatermark("ts", DELAY).groupBy(F.window("ts", "1 hour", "30 minutes")).agg(F.count("*").alias("n"))
    return _finished(told.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n"), spark, "sliding")


@query("""
WITH marked AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM numbered GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
""")
def stream_sessions(spark, sf_dir):
    told = _events(spark, sf_dir).withWatermark("ts", DELAY).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return _finished(told.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), spark, "sessions")


@query("SELECT event_id FROM events")
def stream_dedup(spark, sf_dir):
    """Each file's rows come twice; repeats within the watermark go."""
    rows = _events(spark, sf_dir)
    told = rows.unionByName(_events(spark, sf_dir)).withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"])
    return _finished(told.select("event_id"), spark, "dedup")


@query("""
SELECT p.event_id, v.event_id AS viewed FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts BETWEEN p.ts - INTERVAL 15 MINUTE AND p.ts
WHERE p.event_type = 'purchase' AND v.event_type = 'view'
""")
def stream_stream_join(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type").withWatermark("ts", DELAY)
    p = rows.filter("event_type = 'purchase'")
    v = rows.filter("event_type = 'view'").select(F.col("event_id").alias("viewed"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    near = (F.col("user_id") == F.col("u")) & (F.col("t") >= F.col("ts") - F.expr("INTERVAL 15 MINUTES")) & (F.col("t") <= F.col("ts"))
    return _finished(p.join(v, near).select("event_id", "viewed"), spark, "joined")


@query("SELECT event_id, c_mktsegment AS segment FROM events JOIN customer ON user_id = c_custkey")
def stream_static_join(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return _finished(_events(spark, sf_dir).join(customer, F.col("user_id") == F.col("c_custkey")).select("event_id", "segment"), spark, "static")


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    """State of one's own for each user; a row for each batch and user, of which the last is the sum of all."""
    import pandas as pd

    def add(key, parts, state):
        n, total = state.get if state.exists else (0, 0.0)
        for rows in parts:
            n, total = n + len(rows), total + float(rows["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    rows = _events(spark, sf_dir).select("user_id", "value")
    told = rows.groupBy("user_id").applyInPandasWithState(add, "user_id long, n long, total double", "n long, total double", "append", "NoTimeout")
    last = F.max(F.struct("n", "total")).alias("last")
    return _finished(told, spark, "state").groupBy("user_id").agg(last).select("user_id", "last.n", F.round("last.total", 4).alias("total"))

"""Late rows: told apart from those in time and kept, in a sink that a repeated batch doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.registry import query
from tidewheel.sources.folders import new_folder
from tidewheel.streaming.arrivals import each_wave


class LateSplit:
    """A function for ``foreachBatch``. It keeps all rows, with ``late``: whether ``time`` is further than the delay behind the latest of all earlier batches.

    Rows of batch k are in ``folder``/rows/batch=k and the latest time up to it in ``folder``/marks/batch=k. Both
    follow from the batch and the marks before it, and writing them replaces what the folder of that batch
    had: a batch that is run again, after a crash between the two or later, leaves everything as it was.
    Rows without a time are never late. Work in each batch follows the size of the batch, but for the marks, a row each.
    """

    def __init__(self, folder: str, time: str, delay: str):
        self.folder, self.time, self.delay = folder, time, delay

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, time = batch.sparkSession, F.col(self.time)
        before = self.marks(spark).filter(F.col("batch") < batch_id).agg(F.max("mark")).first()[0] if batch_id else None
        late = F.coalesce(time < F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {self.delay}"), F.lit(False))
        rows = f"{self.folder}/rows/batch={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").parquet(rows)
        mark = spark.read.parquet(rows).agg(F.greatest(F.max(time), F.lit(before).cast("timestamp")).alias("mark"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch_id}")

    def marks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("mark timestamp, batch long").parquet(f"{self.folder}/marks")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


@query("""
WITH r AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
e AS (SELECT event_id, ts, least(3, (4 * (epoch_us(ts) - a)) // (b - a + 1) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END)::INTEGER AS arrived FROM events, r),
m AS (SELECT arrived, max(max(ts)) OVER (ORDER BY arrived ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e GROUP BY arrived)
SELECT event_id, arrived, coalesce(ts < mark - INTERVAL 1 HOUR, false) AS late FROM e JOIN m USING (arrived)
""")
def stream_late(spark, sf_dir):
    """A tenth of the events arrives a wave late. The last run is a restart that finds no new file, and adds nothing."""
    folder = new_folder(spark, "late")
    split = LateSplit(f"{folder}/out", "ts", "1 HOUR")

    def start(stream):
        stream = stream.select("event_id", "ts", F.col("wave").alias("arrived"))
        return stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()

    each_wave(spark, sf_dir, folder, start, held_back=F.col("event_id") % 10 == 3)
    again = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    start(again.withColumn("ts", F.col("ts").cast("timestamp"))).awaitTermination()
    return split.rows(spark).select("event_id", "arrived", "late")

"""ST4: corrections per iteration window as a tumbling event-time window.

Windows of X days are aligned to the anchor date with ``startTime``. By default
there is no watermark: a late row is counted whenever it comes, and the state is one row per
window. With ``lateness`` the state of older windows is given up, and rows that come
later than that are not counted. Update mode writes changed windows per batch into
a change log; readers take the latest count per window.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import instant_to_ntz, ntz_to_instant, read_changelog, write_batch

_EPOCH = dt.date(1970, 1, 1)


def start_windows(spark: SparkSession, source: str, sink: str, checkpoint: str, anchor: dt.date,
                  interval_days: int = 7, lateness: str | None = None, available_now: bool = True,
                  max_files_per_trigger: int | None = None):
    offset = (anchor - _EPOCH).days % interval_days
    reader = spark.readStream.schema("id long, created_at timestamp_ntz")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    events = reader.parquet(source)
    events = events.withColumn("event_time", ntz_to_instant(F.col("created_at")))
    events = events.withWatermark("event_time", lateness) if lateness else events
    agg = (events.groupBy(F.window("event_time", f"{interval_days} days", f"{interval_days} days", f"{offset} days"))
           .agg(F.count(F.lit(1)).alias("correction_count"), F.min("id").alias("feedback_id_start"),
                F.max("id").alias("feedback_id_end")))
    out = agg.select(instant_to_ntz(F.col("window.start")).alias("window_start"),
                     instant_to_ntz(F.col("window.end")).alias("window_end"),
                     "correction_count", "feedback_id_start", "feedback_id_end")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, sink, batch_id)

    w = out.writeStream.outputMode("update").foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_windows(spark: SparkSession, sink: str) -> DataFrame:
    return read_changelog(spark, sink, ["window_start"],
                          "window_start timestamp_ntz, window_end timestamp_ntz, correction_count long, "
                          "feedback_id_start long, feedback_id_end long")

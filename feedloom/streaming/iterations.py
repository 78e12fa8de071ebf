"""ST4, A7, F16 on the stream: minor and major iterations, and late rows aside.

Each micro-batch explodes its corrections into their minor and major iterations, reduces them per
iteration and skill (A9) and writes that small partial result into a folder named by its
batch id. Counts, least and greatest ids are mergeable, so readers add the partial
results up and describe the iterations as the batch form does; a retried batch overwrites its own
folder. With ``lateness`` a row older than the newest one of all earlier batches by more
than that is late: it is written aside whole and counted there, and is not part of the iterations.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.iterations import DEFAULT_INTERVAL_DAYS, DEFAULT_MAJOR_EVERY
from ..operators.iterations import skill_groups, summary_of
from .common import write_batch

SCHEMA = "id long, skill_name string, created_at timestamp_ntz"
_GROUPS = ("iteration_slot long, iteration_type string, skill_name string, feedback_count long, feedback_id_start long, "
           "feedback_id_end long, batch_id long")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def start_iterations(spark: SparkSession, source: str, sink: str, checkpoint: str, anchor: dt.date,
                     interval_days: int = DEFAULT_INTERVAL_DAYS, major_every: int = DEFAULT_MAJOR_EVERY,
                     lateness: dt.timedelta | None = None, available_now: bool = True, max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        late = F.lit(False)
        if lateness is not None:
            newest = _read(s, f"{sink}/marks", "newest timestamp_ntz, batch_id long").filter(F.col("batch_id") < batch_id)
            bound = newest.agg(F.max("newest")).scalar() - F.make_dt_interval(secs=F.lit(lateness.total_seconds()))
            late = F.coalesce(F.col("created_at") < bound, F.lit(False))
        write_batch(skill_groups(batch.filter(~late), anchor, interval_days, major_every), f"{sink}/groups", batch_id)
        write_batch(batch.filter(late), f"{sink}/late", batch_id)
        write_batch(batch.agg(F.max("created_at").alias("newest")), f"{sink}/marks", batch_id)

    w = reader.parquet(source).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_iterations(spark: SparkSession, sink: str, anchor: dt.date, interval_days: int = DEFAULT_INTERVAL_DAYS,
                    major_every: int = DEFAULT_MAJOR_EVERY) -> DataFrame:
    """A7 over all batches so far, the columns of ``operators.iterations.summary``."""
    groups = (_read(spark, f"{sink}/groups", _GROUPS).groupBy("iteration_slot", "iteration_type", "skill_name")
              .agg(F.sum("feedback_count").alias("feedback_count"), F.min("feedback_id_start").alias("feedback_id_start"),
                   F.max("feedback_id_end").alias("feedback_id_end")))
    return summary_of(groups, anchor, interval_days, major_every)


def read_late(spark: SparkSession, sink: str) -> DataFrame:
    """The late rows, as sent."""
    return _read(spark, f"{sink}/late", SCHEMA + ", batch_id long").drop("batch_id")

"""ST1: streaming ingest with quarantine and ids that survive retries.

Each micro-batch is validated (V1-V9, V18); valid rows get ids after the
high-water mark left by the previous batch, in arrival order (W3). The batch
writes its valid rows, its rejects and its new high-water mark into folders
named by its batch id, so a retried batch reads the same previous mark and
overwrites its own output: ids are never skipped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import checks
from ..operators.ids import assign_ids
from .common import write_batch

FEED_SCHEMA = "arrival long, payload string"


def _previous_mark(spark: SparkSession, marks: str, batch_id: int, start: int) -> int:
    if batch_id == 0:
        return start
    row = (spark.read.schema("high_water_mark long, batch_id long").parquet(marks)
           .filter(F.col("batch_id") == batch_id - 1).select("high_water_mark").first())
    if row is None:
        raise ValueError(f"no high-water mark of batch {batch_id - 1} below {marks}; ids would be given twice")
    return int(row[0])


def start_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str,
                 fields: list[checks.Field] | None = None, start_high_water_mark: int = 0,
                 max_files_per_trigger: int | None = None, available_now: bool = True,
                 raw_lines: bool = False):
    """Stream feed files into ``<sink>/valid``, ``<sink>/rejected`` and ``<sink>/marks``.

    By default a file holds JSON records ``{"arrival": n, "payload": "<json text>"}``
    (the producer's sequence orders them). With ``raw_lines`` a file holds one
    payload document per line, and arrival is (file modification time, file
    path, position in the batch's scan). Returns the StreamingQuery.
    """
    fields = fields or checks.CORRECTION_FIELDS
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if raw_lines:
        stream = reader.text(source).select(
            F.col("_metadata.file_modification_time").alias("_mtime"), F.col("_metadata.file_path").alias("_path"),
            F.col("value").alias("payload"))
    else:
        stream = reader.schema(FEED_SCHEMA).json(source)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        if raw_lines:  # positions exist only on the static micro-batch frame
            batch = batch.select(F.struct(F.col("_mtime").alias("file_modification_time"),
                                          F.col("_path").alias("file_path"),
                                          F.monotonically_increasing_id().alias("pos")).alias("arrival"), "payload")
        prev = _previous_mark(s, f"{sink}/marks", batch_id, start_high_water_mark)
        valid, rejected = checks.validate(batch, fields, keep=["arrival"], reserved_skill_field="skill_name",
                                          stage_path=f"{sink}/_stage")  # overwritten by the next batch
        valid = assign_ids(valid, ["arrival"], start_after=prev)
        write_batch(valid, f"{sink}/valid", batch_id)
        write_batch(rejected, f"{sink}/rejected", batch_id)
        n = s.read.parquet(f"{sink}/valid/batch_id={batch_id}").count()
        write_batch(s.createDataFrame([(prev + n,)], "high_water_mark long"), f"{sink}/marks", batch_id)

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()

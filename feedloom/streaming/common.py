"""Shared helpers: instants for event-time operators and change-log reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_to_instant(c: Column) -> Column:
    """UTC wall-clock TIMESTAMP_NTZ -> TIMESTAMP instant, independent of the session zone
    (``withWatermark`` and ``window`` need a TIMESTAMP)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c))


def instant_to_ntz(c: Column) -> Column:
    """TIMESTAMP instant -> UTC wall-clock TIMESTAMP_NTZ."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_EPOCH_NTZ))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Overwrite this batch's own folder (idempotent on retry)."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_changelog(spark: SparkSession, path: str, keys: list[str], schema: str | None = None) -> DataFrame:
    """Latest row per key over all batches (``max_by`` of the batch id, combinable)."""
    r = spark.read
    if schema:
        r = r.schema(schema + ", batch_id long")
    log = r.parquet(path)
    value_cols = [c for c in log.columns if c not in keys and c != "batch_id"]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), F.col("batch_id")).alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value_cols])

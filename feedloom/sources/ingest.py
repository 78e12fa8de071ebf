"""Raw JSON feeds (S1-S4): text lines -> validated, typed rows + quarantine.

A feed frame has a ``payload`` column (one JSON document per row) and an
``arrival`` column that orders the records (a sequence from the producer, a
log offset, or (file modification time, file path, position) for files).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators import checks
from ..operators.ids import assign_ids
from ..operators.upgrades import check_titles


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines from files; arrival = (file modification time, file path, position in scan)."""
    raw = spark.read.text(path).select(F.col("value").alias("payload"), "_metadata.file_path",
                                       "_metadata.file_modification_time")
    return raw.select(F.struct("file_modification_time", "file_path",
                               F.monotonically_increasing_id().alias("pos")).alias("arrival"), "payload")


def ingest_invocations(raw: DataFrame, high_water_mark: int = 0) -> tuple[DataFrame, DataFrame]:
    """Valid invocations with ids after the high-water mark (arrival order), and rejects."""
    valid, rejected = checks.validate(raw, checks.INVOCATION_FIELDS, keep=["arrival"],
                                      reserved_skill_field="skill_name")
    return assign_ids(valid, ["arrival"], start_after=high_water_mark), rejected


def ingest_corrections(raw: DataFrame, high_water_mark: int = 0) -> tuple[DataFrame, DataFrame]:
    """As S1 for corrections."""
    valid, rejected = checks.validate(raw, checks.CORRECTION_FIELDS, keep=["arrival"],
                                      reserved_skill_field="skill_name")
    return assign_ids(valid, ["arrival"], start_after=high_water_mark), rejected


def validate_corrections(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S2 without ids: (valid, rejected)."""
    return checks.validate(raw, checks.CORRECTION_FIELDS, keep=["arrival"], reserved_skill_field="skill_name")


def checked_mr_posts(raw: DataFrame) -> DataFrame:
    """S3: schema checks, range order and merged_at rules, then the title checks (V11, V12), in one pass."""
    titled = check_titles(checks.check(raw, checks.MR_FIELDS, rules=checks.MR_RULES, keep=["arrival"]))
    return checks.add_errors(titled, checks.error_list([("title", F.col("title_error"))])).drop("title_error")


def validate_mr_posts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3 as (valid, rejected); every rejected row keeps its payload, so it can be replayed."""
    return checks.split(checked_mr_posts(raw), checks.MR_FIELDS, keep=["arrival"])


def checked_status_updates(raw: DataFrame, mrs: DataFrame) -> DataFrame:
    """Raw rows carry ``id`` (the MR id of the request) and ``payload``; an id that
    is none, or that names no MR, is an error (J5)."""
    typed = checks.check(raw, checks.STATUS_FIELDS, rules=checks.STATUS_RULES, keep=["arrival", "id"])
    known = mrs.select(F.col("id").alias("_known")).distinct()
    typed = typed.join(known, typed["id"] == known["_known"], "left")
    of_id = (F.when(~F.coalesce(F.col("id") > 0, F.lit(False)), F.lit("invalid_id")).when(F.col("_known").isNull(), F.lit("not_found")))
    return checks.add_errors(typed, checks.error_list([("id", of_id)])).drop("_known")


def validate_status_updates(raw: DataFrame, mrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S4 as (valid, rejected)."""
    return checks.split(checked_status_updates(raw, mrs), checks.STATUS_FIELDS, keep=["arrival", "id"])


def checked_invocations(raw: DataFrame) -> DataFrame:
    return checks.check(raw, checks.INVOCATION_FIELDS, keep=["arrival"], reserved_skill_field="skill_name")


def fan_out(checked: DataFrame, path: str) -> dict[str, int]:
    """Write checked rows once, as ``<path>/outcome=valid`` and ``<path>/outcome=rejected``; returns the counts of both, observed
    while writing. Valid rows lose their payload (their fields hold it), rejected rows keep it."""
    good = F.size("errors") == 0
    seen = Observation()
    (checked.withColumn("outcome", F.when(good, "valid").otherwise("rejected")).withColumn("payload", F.when(~good, F.col("payload")))
     .observe(seen, F.count_if(good).alias("valid"), F.count_if(~good).alias("rejected"))
     .write.mode("overwrite").partitionBy("outcome").parquet(path))
    return {k: int(v) for k, v in seen.get.items()}


def read_outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    """The valid or the rejected rows of a fan-out: one folder, by partition pruning."""
    return spark.read.parquet(path).filter(F.col("outcome") == outcome).drop("outcome")

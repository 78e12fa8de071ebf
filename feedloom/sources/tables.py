"""Table scans (S5), foreign-row decoding (P3) and id filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import CORRECTIONS, INVOCATIONS, MERGE_REQUESTS, PURGE_AUDIT

SCHEMAS = {"invocations": INVOCATIONS, "corrections": CORRECTIONS, "merge_requests": MERGE_REQUESTS,
           "purge_audit": PURGE_AUDIT}


def scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A stored table read with its explicit schema (no inference; Catalyst prunes
    columns and pushes filters into the Parquet scan)."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def decode_stored_rows(rows: DataFrame) -> DataFrame:
    """Rows exported by the service's own storage (array as JSON text in
    ``tech_stack_json``, flags as 0/1) to this library's types."""
    out = rows
    if "tech_stack_json" in rows.columns:
        out = out.withColumn("tech_stack", F.from_json("tech_stack_json", "array<string>")).drop("tech_stack_json")
    if "needs_batch_review" in rows.columns:
        out = out.withColumn("needs_batch_review", F.col("needs_batch_review") == 1)
    return out


def in_id_range(rows: DataFrame, start: int, end: int, id_col: str = "id") -> DataFrame:
    """Rows with start <= id <= end (pushed to the scan as two bounds)."""
    return rows.filter(F.col(id_col).between(F.lit(start), F.lit(end)))


def count_in_id_range(rows: DataFrame, start: int, end: int, id_col: str = "id") -> DataFrame:
    """A5: one row with the number of rows in a closed id range."""
    return in_id_range(rows, start, end, id_col).agg(F.count(F.lit(1)).alias("count"))

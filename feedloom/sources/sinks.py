"""Sinks: CSV export (K1), appended tables (K3), and tables stored by id block.

A table by id block is plain Parquet, partitioned by ``_blk`` = id div BLOCK_IDS. Changing some
blocks is a dynamic partition overwrite: Spark writes the new files aside and puts
them in place of those blocks' old ones when the job commits, so all other blocks
stay as they are and replaced rows leave the disk. A block never holds more than BLOCK_IDS rows, as ids are unique.
A copy by created day serves date ranges and is replaced in the same way, by day. A block or day that loses its last row keeps one row without an id, because
a partition that gets no row is not overwritten; readers skip such rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.arrays import floor_div

BLOCK_IDS = 1 << 20
BLOCK_COL = "_blk"
DAY_COL = "created_day"


def write_csv(corrections: DataFrame, path: str, date_from: str | None = None, date_to: str | None = None) -> None:
    """K1: the export as exact CSV text: header, then the K2 lines in id order.

    The lines are this library's own CSV text (F1 per cell), written as text
    after a range-partitioned sort on id, so the part files concatenate in
    order. The only difference to the service's text is the newline after the
    last line. (Spark's CSV writer is not used here: it rewrites a CR inside a
    quoted value as LF.)
    """
    from ..operators.export import csv_header, csv_lines, in_date_range

    rows = corrections if date_from is None else in_date_range(corrections, date_from, date_to)
    lines = csv_lines(rows)
    header = corrections.sparkSession.createDataFrame([(None, csv_header())], "id long, line string")
    (header.unionByName(lines).orderBy(F.col("id").asc_nulls_first()).select("line")
     .write.mode("overwrite").option("lineSep", "\n").text(path))


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K3: append rows to a Parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stored(spark: SparkSession, base: str, table: str, schema: T.StructType) -> DataFrame:
    """A stored table; without rows where nothing was written yet. Only a missing path counts as that."""
    try:
        return spark.read.schema(schema).parquet(f"{base}/{table}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def block_col(df: DataFrame, block_ids: int | None = None) -> DataFrame:
    return df.withColumn(BLOCK_COL, floor_div(F.col("id"), block_ids or BLOCK_IDS))


def _stored_blocks(spark: SparkSession, base: str, table: str, schema: T.StructType) -> DataFrame:
    nullable = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    return read_stored(spark, base, table, T.StructType(nullable + [T.StructField(BLOCK_COL, T.LongType())]))


def read_blocks(spark: SparkSession, base: str, table: str, schema: T.StructType, blocks: DataFrame | None = None) -> DataFrame:
    """A table stored by id block, or those of its blocks that ``blocks`` (column ``_blk``) names: a
    semi-join on the partition column, so other folders are not read."""
    rows = _stored_blocks(spark, base, table, schema)
    if blocks is not None:
        rows = rows.join(blocks, BLOCK_COL, "left_semi")
    return rows.filter("id IS NOT NULL").select(*[f.name for f in schema.fields])


def _replace(rows: DataFrame, parts: DataFrame, part_col: str, path: str) -> None:
    columns = [c for c in rows.columns if c != part_col]
    gone = parts.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns], part_col)
    # a range of (partition, id) per task: a hot partition is spread over tasks, and files are ordered by id
    (rows.unionByName(gone).repartitionByRange(part_col, "id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path))


def replace_blocks(rows: DataFrame, blocks: DataFrame, base: str, table: str) -> None:
    """Put ``rows`` in place of what the ``blocks`` (column ``_blk``, distinct) hold. ``rows`` may be read from the same table."""
    _replace(block_col(rows), blocks, BLOCK_COL, f"{base}/{table}")


def append_blocks(rows: DataFrame, base: str, table: str) -> None:
    """K3: append rows with new ids to a table stored by id block, and keep the largest id given (T7: a purge never frees an id)."""
    mark = rows.agg(F.max("id").alias("top")).filter("top IS NOT NULL").select(F.lit(table).alias("table_name"), "top")
    append(mark, f"{base}/_marks")
    append(block_col(rows).repartitionByRange(BLOCK_COL, "id"), f"{base}/{table}", [BLOCK_COL])


def high_water_mark(spark: SparkSession, base: str, table: str) -> DataFrame:
    """One row, ``top``: the largest id ever given in the table (0 where none was); ``.scalar()`` makes it a column."""
    marks = read_stored(spark, base, "_marks", T.StructType([T.StructField("table_name", T.StringType()), T.StructField("top", T.LongType())]))
    return marks.filter(F.col("table_name") == table).agg(F.coalesce(F.max("top"), F.lit(0)).alias("top"))


def blocks_of_steps(spark: SparkSession, base: str, table: str, steps: DataFrame) -> DataFrame:
    """(_blk) of the stored blocks that hold an id some owner of the ``steps`` (``operators.ranges.owner_steps``) covers.
    Ids and block numbers are read, nothing else."""
    from ..operators.ranges import owner_at

    ids = _stored_blocks(spark, base, table, T.StructType([T.StructField("id", T.LongType())])).filter("id IS NOT NULL")
    return owner_at(ids, steps, out="_owner").filter("_owner IS NOT NULL").select(BLOCK_COL).distinct()


def append_days(rows: DataFrame, base: str, table: str) -> None:
    """K3: append rows to a copy partitioned by created day, for date ranges (P1): bounds on the day prune folders."""
    days = rows.withColumn(DAY_COL, F.to_date("created_at"))
    append(days.repartitionByRange(DAY_COL, "id"), f"{base}/{table}", [DAY_COL])


def read_days(spark: SparkSession, base: str, table: str, schema: T.StructType) -> DataFrame:
    """The copy by created day, with its column ``created_day`` (``operators.export.in_date_range`` uses it)."""
    nullable = [T.StructField(f.name, f.dataType, True) for f in schema.fields]
    rows = read_stored(spark, base, table, T.StructType(nullable + [T.StructField(DAY_COL, T.DateType())]))
    return rows.filter("id IS NOT NULL")


def replace_days(rows: DataFrame, days: DataFrame, base: str, table: str) -> None:
    """Put ``rows`` (with ``created_day``) in place of what the ``days`` (column ``created_day``, distinct) hold."""
    _replace(rows, days, DAY_COL, f"{base}/{table}")

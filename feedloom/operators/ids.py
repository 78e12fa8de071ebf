"""Dense ids in arrival order, without a one-partition window.

The order keys are cut into parts by bounds from a sketch of the keys: the rows whose
key hash is below SAMPLE / count, about SAMPLE of them at any size. Count and sketch are
mergeable aggregates and a function of the rows alone, so the bounds, and with them the part of a
row, come out the same however often and wherever they are evaluated. So nothing is stored
or checkpointed, and a lost executor changes no id. The number of parts follows from
the row count. A row's id is the number of rows in earlier parts (one row per part,
at most PARTS) plus its place in its own part.

Bounds and counts are read inside the plan (an uncorrelated subquery and a broadcast of one row per
part); no job runs while the plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import search

ROWS_PER_PART = 1 << 18
PARTS = 1 << 12  # at most
SAMPLE = 1 << 16  # keys in the sketch, about: 16 per part and more
_GRAIN = 1 << 30


def _bounds(keys: DataFrame, rows_per_part: int) -> DataFrame:
    """One row: the first keys of all parts but the first, ascending."""
    rows = keys.agg(F.count(F.lit(1))).scalar()
    hashed = F.pmod(F.xxhash64("_key"), F.lit(_GRAIN)).cast("double") / _GRAIN
    parts = F.least(F.lit(PARTS), F.ceil(F.col("_rows") / rows_per_part)).cast("int")
    sketch = (keys.filter(hashed * rows <= SAMPLE)
              .agg(F.sort_array(F.collect_set("_key")).alias("_sorted")).withColumn("_rows", rows).withColumn("_parts", parts))
    place = lambda i: F.element_at("_sorted", (i * F.size("_sorted") / F.col("_parts")).cast("int") + 1)
    return sketch.select(F.when((F.col("_parts") > 1) & (F.size("_sorted") > 0), F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), place)))


def assign_ids(df: DataFrame, order_cols: list[str | Column], id_col: str = "id", start_after: int | Column = 0,
               rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Number rows 1, 2, ... (plus ``start_after``, the high-water mark) in ``order_cols`` order.

    ``order_cols`` must identify a row (ties would get an arbitrary order).
    """
    key = F.struct(*order_cols)
    bounds = _bounds(df.select(key.alias("_key")), rows_per_part).scalar()

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bounds", bounds).withColumn("_part", search(F.col("_bounds"), F.col("_key"), PARTS)).drop("_bounds")

    counts = placed(df.select(key.alias("_key"))).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    base = start_after if isinstance(start_after, Column) else F.lit(int(start_after))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_key"))
    return (placed(df.withColumn("_key", key)).withColumn("_row", within).join(F.broadcast(offsets), "_part")
            .withColumn(id_col, (base + F.col("_off") + F.col("_row")).cast("long"))
            .drop("_key", "_part", "_row", "_off"))

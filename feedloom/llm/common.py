"""Helpers shared by the corpus operators: Arrow batches cut by bytes, stable hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], text_index: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding at most ``limit`` text bytes each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(text_index)
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - 1) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: spreads the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

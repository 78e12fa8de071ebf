"""Connected components of a link table by alternating star contractions, as DataFrames in a shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def stored(df: DataFrame, path: str, **metrics) -> tuple[DataFrame, dict]:
    """The frame written below ``path`` and read again (cuts the lineage; survives lost executors)."""
    seen = Observation()
    df = df.observe(seen, *[m.alias(k) for k, m in metrics.items()]) if metrics else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), (seen.get if metrics else {})


def components(links: DataFrame, path: str, a: str = "a", b: str = "b", limit: int = 100) -> DataFrame:
    """``node, root``: the smallest node of each linked node's component (the root itself included).

    Every round joins each node's larger neighbours to its smallest neighbour
    (large star), then its smaller neighbours to the smallest (small star), until nothing
    changes; the number of rounds grows with the logarithm of the longest path.
    A node with very many links only adds rows to a combinable minimum and to a
    join that adaptive execution can split.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    sign = dict(n=F.count(F.lit(1)), s=F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)))
    edges, before = stored(edges, f"{path}/0", **sign)
    for k in range(1, limit + 1):
        if before["n"] == 0:
            break
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()  # u > v
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(low, F.col("u") == F.col("c"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(
            low.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
        edges, after = stored(small, f"{path}/{k}", **sign)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Centroid clustering of integer vectors by scalar lookup tables (Lloyd's rounds).

A vector is kept if it has exactly ``dims`` components, none null or not finite;
a component x becomes the integer floor(SCALE * x). The kept vectors are stored
once, in blocks of ``BLOCK``: per dimension the integers that occur in the block
and, per vector, the place of its own among them. A round tabulates for every
dimension, occurring integer and centroid the squared difference; the distances of
a block are gathers from these tables, summed over the dimensions. The sums of a
cluster come from the same places: how often each integer occurs in it, times the integer.

A block sends one row per cluster and dimension, added up in Spark (map side
first); the driver sees k * dims sums a round, whatever the size of the table.
The blocks are a written table in the shared folder, so a round reads it anew
and a lost executor costs its tasks only. Nothing is joined or sorted.

Centroids start as the k kept vectors with the smallest lowercase-hex SHA-256 of
``<seed>:<id>``, in that order. Every round assigns each vector to its nearest
centroid (ties: the smaller number) and replaces each non-empty centroid by the exact
floor(sum / count) of its vectors; after the last round they are assigned once more.

All arithmetic is exact: integers that are too large for 64-bit squares are
computed as Python integers, and sums travel in pieces of 40 bits.

Defined results: vectors of another length, null vectors and those with a null, NaN
or infinite component (also after scaling) give no row; rows that repeat an id are
vectors of their own (as centroids they tie by their components); a null id is
clustered like any other but never starts a centroid; with fewer than k vectors
there are fewer centroids; without centroids (no row, or null ids only) the result is empty; a
distance or inertia beyond a long is null; columns other than id and vector are not
read, so no column name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
BLOCK = 4096  # vectors of a block
SMALL = float(1 << 27)  # below, squares and their sums over 2^8 dimensions fit in 64 bits
PIECE = 40  # bits of a sum that travel together
LONG = 1 << 63


def integers(col: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows kept, their vectors as whole numbers in float64) of a list column."""
    col = col.cast(pa.list_(pa.float64()))
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(col), -1)) == dims)
    x = pc.list_flatten(col.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null components become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(x * scale)
    good = np.isfinite(x).all(1)
    return rows[good], x[good] + 0.0  # no negative zero


def store_blocks(vectors: DataFrame, path: str, id_col: str, vector_col: str, dims: int = DIMS, scale: float = SCALE,
                 block: int = BLOCK) -> None:
    """The kept vectors as a table of blocks: ids, per dimension the occurring integers, and the places of the vectors' own."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block):
                part = b.slice(lo, block)
                rows, x = integers(part.column(1), dims, scale)
                if not len(rows):
                    continue
                values, places = zip(*(np.unique(x[:, d], return_inverse=True) for d in range(dims)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).take(pa.array(rows))], pa.list_(part.column(0).type)),
                     pa.array([[v.tolist() for v in values]], pa.list_(pa.list_(pa.float64()))),
                     pa.array([np.stack(places).astype("<u2").tobytes()], pa.binary())], names=["ids", "found", "places"])

    if not 0 < block <= 1 << 16:
        raise ValueError("a block holds 1 to 65536 vectors")
    src = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vector"))
    src.mapInArrow(run, f"ids array<{kind}>, found array<array<double>>, places binary").write.parquet(path)


def _numbers(values: np.ndarray, centre: list[int]) -> tuple[np.ndarray, list[int]]:
    """Whole numbers as int64 where squares of their differences are safe, else as Python integers."""
    if max(map(abs, centre), default=0) < SMALL and (not len(values) or np.abs(values).max() < SMALL):
        return values.astype(np.int64), centre
    return np.array([int(v) for v in values.tolist()] + [0], object)[:-1], centre


def _assign(found: list, places: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(cluster, squared distance, integers per dimension) of a block's vectors."""
    total = np.zeros((places.shape[1], len(centroids)), np.int64)
    values = []
    for d, own in enumerate(found):
        value, centre = _numbers(np.asarray(own), [c[d] for c in centroids])
        values.append(value)
        table = (value[:, None] - np.array(centre, value.dtype)) ** 2  # occurring integer x centroid
        total = total + table[places[d]]
    cluster = total.argmin(1).astype(np.int64)
    return cluster, total[np.arange(len(total)), cluster], values


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, list, np.ndarray]]:
    for b in batches:
        for k in range(b.num_rows):
            places = np.frombuffer(b.column("places")[k].as_py(), "<u2").reshape(dims, -1)
            yield b.column("ids").slice(k, 1).flatten(), b.column("found")[k].as_py(), places


def _sums(spark, path: str, centroids: list[list[int]], dims: int, block_rows) -> dict[tuple[int, int], int]:
    """(cluster, dimension) -> sum over the table of what ``block_rows`` gives for a block; exact."""
    def run(batches):
        for _, found, places in _blocks(batches, dims):
            out = []
            for cluster, dim, value in block_rows(found, places, centroids):
                value, power = int(value), 0
                while abs(value) >= 1 << 59:
                    out.append((cluster, dim, power, value & ((1 << PIECE) - 1)))
                    value, power = value >> PIECE, power + 1
                out.append((cluster, dim, power, value))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["cluster", "dim", "power", "value"])

    rows = (spark.read.parquet(path).mapInArrow(run, "cluster long, dim long, power long, value long")
            .groupBy("cluster", "dim", "power").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect())
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        key = (r["cluster"], r["dim"])
        total[key] = total.get(key, 0) + (int(r["value"]) << (PIECE * r["power"]))
    return total


def _movement(found, places, centroids):
    """Per cluster of a block its number of vectors (as dimension -1) and their sums."""
    cluster, _, values = _assign(found, places, centroids)
    k = len(centroids)
    count = np.bincount(cluster, minlength=k)
    for c in np.flatnonzero(count).tolist():
        yield c, -1, count[c]
    for d, value in enumerate(values):
        n = len(value)
        often = np.bincount(cluster * n + places[d], minlength=k * n).reshape(k, n)
        total = often.astype(value.dtype) @ value
        for c in np.flatnonzero(count).tolist():
            yield c, d, total[c]


def _spread(found, places, centroids):
    """Per cluster of a block the sum of its squared distances."""
    cluster, distance, _ = _assign(found, places, centroids)
    for c in np.unique(cluster).tolist():
        yield c, 0, sum(distance[cluster == c].tolist())


def _first_centroids(spark, path: str, k: int, seed: int, dims: int) -> list[list[int]]:
    """The k stored vectors with the smallest hash of the id; k rows reach the driver."""
    def run(batches):
        for ids, found, places in _blocks(batches, dims):
            names = ids.cast(pa.string()).to_pylist()
            keyed = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), j) for j, i in enumerate(names) if i is not None)
            # k of a block that come first by hash, and all that tie with the last of them
            keyed = [x for x in keyed if x[0] <= keyed[:k][-1][0]]
            x = [[found[d][p] for d, p in enumerate(places[:, j].tolist())] for _, j in keyed]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in keyed], pa.string()), pa.array(x, pa.list_(pa.float64()))],
                                             names=["hash", "x"])

    rows = spark.read.parquet(path).mapInArrow(run, "hash string, x array<double>").orderBy("hash", "x").limit(k).collect()
    return [[int(v) for v in r["x"]] for r in sorted(rows, key=lambda r: (r["hash"], r["x"]))]


def train(spark, path: str, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over the stored blocks."""
    centroids = _first_centroids(spark, path, k, seed, dims)
    for _ in range(rounds if centroids else 0):
        total = _sums(spark, path, centroids, dims, _movement)
        moved = [[total[c, d] // total[c, -1] for d in range(dims)] if (c, -1) in total else old for c, old in enumerate(centroids)]
        if moved == centroids:  # further rounds change nothing
            break
        centroids = moved
    return centroids


def cluster_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS,
                    rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid`` per kept vector; ``path``: a new folder in the shared one."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    store_blocks(vectors, path, id_col, vector_col, dims, scale, block)
    centroids = train(spark, path, k, rounds, seed, dims)
    spread = _sums(spark, path, centroids, dims, _spread) if centroids else {}
    fits = lambda v: v if v < LONG else None
    inertia = fits(sum(spread.values()))
    of_cluster = [fits(spread.get((c, 0), 0)) for c in range(len(centroids))]
    names = [",".join(map(str, c)) for c in centroids]

    def run(batches):
        for ids, found, places in _blocks(batches, dims) if centroids else ():
            cluster, distance, _ = _assign(found, places, centroids)
            own = cluster.tolist()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array([fits(v) for v in distance.tolist()], pa.int64()),
                 pa.array([of_cluster[c] for c in own], pa.int64()), pa.array([inertia] * len(own), pa.int64()),
                 pa.DictionaryArray.from_arrays(pa.array(own, pa.int32()), pa.array(names, pa.string())).cast(pa.string())],
                names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    schema = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid string"
    return spark.read.parquet(path).mapInArrow(run, schema)

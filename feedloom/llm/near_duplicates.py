"""Near-duplicate documents by min-max hashing.

Each hash evaluation of a shingle serves twice: a document keeps the smallest
and the largest value under every permutation. The signature is cut into
bands of ``BAND`` values; the number of bands follows from the threshold and
``MISS``, the chance that a pair just at the threshold meets in no band.

Documents with equal shingle sets form a class and are handled once. Pairs come
from the bands without listing all pairs of a bucket: first every class is
compared with the smallest class of its bucket (the pivot; the classes compared with one pivot
are a family). Classes that are then connected need no further comparison. In families that are
not yet connected, classes are described by their differences from the family's
middle, and only unconnected classes whose differences meet are compared (an exact filter,
see ``differences``). Links are confirmed on whole sets; the components of the links are the
result.

Defined results: a null, empty or wordless text has an empty set, is linked with
nothing and is its own component; repeated rows are copies of each other; a null id
is never the smallest id of a component (a component without ids has a null
component id, and all its rows are kept); an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, mix64, text_bytes
from .components import components, stored
from .shingles import shingle_hashes, word_hashes

BAND = 4
MISS = 1e-6
VOTERS = 25  # classes of a family that vote on its middle, at most
BATCH_BYTES = 1 << 20


def bands_for(percent: int, miss: float = MISS, band: int = BAND) -> int:
    """Bands such that a pair at the threshold shares none with a chance of ``miss`` at most; an even number of values."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** band)))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    h, n = shingle_hashes(*word_hashes(texts), size)
    ends = np.cumsum(n)
    return [np.unique(h[e - k:e]) for e, k in zip(ends, n)]


def set_key(s: np.ndarray) -> bytes:
    """128-bit name of a set, from sums that don't depend on order."""
    a = int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    b = int(mix64(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
    return a.to_bytes(8, "big") + (b ^ len(s)).to_bytes(8, "big")


def band_hashes(sets: list[np.ndarray], bands: int, band: int = BAND) -> np.ndarray:
    """(texts, bands) hashes of signature bands; every permutation gives a minimum and a maximum."""
    perms = (bands * band + 1) // 2
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    keys = mix64(np.arange(1, 2 * perms + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    sig = np.empty((2 * perms, len(sets)), np.uint64)
    for j in range(perms):
        x = flat * (keys[2 * j] | np.uint64(1)) + keys[2 * j + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xE7037ED1A0B428DB)
        sig[2 * j] = np.minimum.reduceat(x, at)
        sig[2 * j + 1] = np.maximum.reduceat(x, at)
    out = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands):
        for r in range(band):
            out[:, k] = mix64(out[:, k] + sig[(k * band + r) % (2 * perms)])
    return out


def signatures(docs: DataFrame, bands: int, size: int, id_col: str, text_col: str, digest: bool = False) -> DataFrame:
    """``id, n_shingles, key, bands, text_crc32`` (and ``text_sha256``) per row (key and bands null for an empty set)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_shingles", "key", "bands", "text_crc32"] + ["text_sha256"] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1, BATCH_BYTES):
            texts = text_bytes(b.column(1))
            sets = shingle_sets(texts, size)
            full = [i for i, s in enumerate(sets) if len(s)]
            rows: list = [None] * len(sets)
            if full:
                for i, x in zip(full, band_hashes([sets[i] for i in full], bands).astype(np.int64)):
                    rows[i] = x
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array(rows, pa.list_(pa.int64())),
                 pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                 *([pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())] if digest else [])], names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"id {kind}, n_shingles long, key binary, bands array<bigint>, text_crc32 long" + ", text_sha256 binary" * digest)


def sets_of(docs: DataFrame, size: int, text_col: str) -> DataFrame:
    """``key, shingles`` (packed) per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH_BYTES):
            sets = [s for s in shingle_sets(text_bytes(b.column(0)), size) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "shingles"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "key binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def differences(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``f, key, n, slack, size, first, bits``: how each class of a family differs from the family's middle.

    The middle is the set of shingles that most of at most ``VOTERS`` classes of the family hold; any reference set gives
    right results, this one makes the differences small and rare. With D the symmetric difference of a class
    and the middle (``size`` elements), two classes differ by |D1| + |D2| - 2 |D1 and D2| shingles. So:

    - classes whose ``slack`` (100 - percent) n - (100 + percent) |D| add up to 0 or more are linked for sure;
    - all others are linked only if their D share (-slack1 - slack2) / 2 (100 + percent) elements or more.

    ``first`` are the leading elements of D, those that fewest voters have in their D first (then by value: one order for the
    whole family). A class shares at least |D| - s elements with one that it is linked to, s being the largest difference of
    two linked classes, so no more than s + 1 are kept. ``bits`` are the parities of D in 256 cells: two classes
    differ by at least as many shingles as their parities do.
    """
    slot = F.pmod(F.xxhash64("key"), F.lit(VOTERS))
    voters = (family.groupBy("f", slot.alias("slot")).agg(F.min(F.struct(F.col("root") != F.col("f"), F.xxhash64("key"), "key")).alias("v"))
              .select("f", F.col("v.key").alias("key")))

    def middle(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        value, n = np.unique(np.concatenate(held), return_counts=True)
        known = (n > 1) | (2 * n > len(held))
        return pa.table({"f": table.column("f").slice(0, 1), "common": pa.array([value[known].tobytes()], pa.binary()),
                         "times": pa.array([n[known].astype(np.uint8).tobytes()], pa.binary()), "voters": pa.array([len(held)], pa.int64())})

    middles = (voters.join(sets, "key").select("f", "shingles").groupBy("f")
               .applyInArrow(middle, "f binary, common binary, times binary, voters long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slack, size, first, bits = [], [], [], []
            for n, x, common, times, voters in zip(b.column(2).to_pylist(), *(b.column(i) for i in range(3, 6)), b.column(6).to_pylist()):
                x, common = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(common.as_buffer(), np.uint64)
                times = np.frombuffer(times.as_buffer(), np.uint8).astype(np.int64)
                inside = 2 * times > voters
                more = np.setdiff1d(x, common[inside], assume_unique=True)
                less = np.setdiff1d(common[inside], x, assume_unique=True)
                d = np.concatenate([more, less])
                seen = np.zeros(len(d), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, d), len(common) - 1)
                    seen = np.where(common[at] == d, np.minimum(times, voters - times)[at], 0)
                most = (100 - percent) * (n + 100 * n // percent) // (100 + percent) + 1
                size.append(len(d))
                slack.append((100 - percent) * n - (100 + percent) * len(d))
                first.append(d[np.lexsort((d, seen))][:most].view(np.int64))
                bits.append(np.packbits(np.bincount((d >> np.uint64(56)).astype(np.int64), minlength=256) & 1).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(slack, pa.int64()), pa.array(size, pa.int64()), pa.array(first, longs), pa.array(bits, longs)],
                names=["f", "key", "n", "slack", "size", "first", "bits"])

    return (family.join(sets, "key").join(middles, "f").select("f", "key", "n", "shingles", "common", "times", "voters")
            .mapInArrow(run, "f binary, key binary, n long, slack long, size long, first array<bigint>, bits array<bigint>"))


def sharing(diffs: DataFrame, best: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of unconnected classes of a family that may be linked (``best``: the largest slack per family).

    Exact filters, all applied inside the join: the classes share one of their rarest differences (so many that a linked
    class can't lie beyond them, given the largest slack of those it isn't connected to), enough differences are left
    behind the place where they meet, their sizes allow the threshold, and so do the parities of their differences.
    Of each meeting place's classes, those of the largest component are not compared with each other.
    """
    unit = 2 * (100 + percent)
    sure = F.col("slack") + F.col("best.slack") >= 0  # connected to the best class
    loose = diffs.join(best, "f").groupBy("f").agg(F.max(F.when(~sure, F.col("slack"))).alias("loose")).filter("loose is not null")
    short = -(F.col("slack") + F.when(sure, F.col("loose")).otherwise(F.col("best.slack")))
    needed = F.greatest(F.lit(1), F.ceil(short / F.lit(unit))).cast("int")
    rooted = (diffs.join(best, "f").join(loose, "f")
              .withColumn("first", F.slice("first", 1, F.greatest(F.lit(0), F.least(F.size("first"), F.col("size").cast("int") - needed + 1))))
              .join(root, F.col("key") == F.col("node"), "left").withColumn("root", F.xxhash64(F.coalesce("root", "key"))))
    bits = [f"b{i}" for i in range(4)]
    about = ["key", "n", "root", "slack", "left", *bits]
    rows = (rooted.select("f", "key", "n", "root", "slack", "size", *[F.col("bits")[i].alias(c) for i, c in enumerate(bits)],
                          F.posexplode("first").alias("at", "e"))
            .withColumn("left", F.col("size") - F.col("at")).select(F.xxhash64("f", "e").alias("place"), *about))
    open_ = (rows.groupBy("place", "root").count().groupBy("place")
             .agg(F.max(F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
             .select("place", F.col("main.root").alias("main")))
    there = rows.join(open_, "place")
    other = there.filter("root <> main").select("place", *[F.col(c).alias(f"{c}2") for c in about])
    lacking = -(F.col("slack") + F.col("slack2"))  # ``unit`` times the elements that must be shared
    enough = lacking <= unit * F.least("left", "left2")
    most = (100 - percent) * (F.col("n") + F.col("n2"))  # 100 + percent times the shingles by which linked classes differ at most
    near = (100 + percent) * F.abs(F.col("n") - F.col("n2")) <= most
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in bits), F.lit(0))
    meet = ((there["place"] == other["place"]) & (F.col("root") != F.col("root2")) & (lacking > 0) & enough & near
            & ((100 + percent) * apart <= most))
    return there.join(other, meet).select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, path: str, percent: int = 80, size: int = 5, id_col: str = "doc_id",
                    text_col: str = "text", digest: bool = False) -> DataFrame:
    """``id, n_shingles, component_id, kept, text_crc32`` per row; intermediate tables are written below ``path``. ``digest`` adds
    ``text_sha256``, which tells rows with equal ids apart."""
    names = ["text_crc32"] + ["text_sha256"] * digest
    near = lambda n, m: (100 * F.least(n, m) >= percent * F.greatest(n, m))  # noqa: E731  sizes alone allow the threshold
    rows, _ = stored(signatures(docs, bands_for(percent), size, id_col, text_col, digest), f"{path}/signatures")
    classes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    in_bands = classes.select("key", "rep", "n", F.posexplode("bands").alias("band", "hash"))
    shared = (in_bands.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("key", "n")).alias("pivot"))
              .filter("c > 1").select("band", "hash", "pivot"))
    members, _ = stored(in_bands.join(shared, ["band", "hash"]), f"{path}/members")
    # stored, so that its size is known: while the ids are few they are broadcast and no text is exchanged
    reps, _ = stored(members.select("rep").distinct(), f"{path}/reps")
    of_members = (docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t"))
                  .join(reps, F.col("_i").eqNullSafe(F.col("rep")), "left_semi"))
    sets, _ = stored(sets_of(of_members, size, "_t"), f"{path}/sets")

    stars = (members.filter((F.col("key") != F.col("pivot.key")) & near(F.col("n"), F.col("pivot.n")))
             .select(F.col("pivot.key").alias("a"), F.col("key").alias("b")).distinct())
    links, _ = stored(confirmed(stars, sets, percent), f"{path}/links1")
    root = components(links, f"{path}/components1")
    # families: the classes that share a bucket whose pivot lies in component f
    named = lambda c: root.select(F.col("node").alias(f"_{c}"), F.col("root").alias(c))
    family = (members.select(F.col("pivot.key").alias("p"), "key", "n").distinct()
              .join(named("f"), F.col("p") == F.col("_f"), "left").select(F.coalesce("f", "p").alias("f"), "key", "n").distinct()
              .join(named("root"), F.col("key") == F.col("_root"), "left").select("f", "key", "n", F.coalesce("root", "key").alias("root")))
    # a class that is not connected to the pivot can still be connected to another of the family
    mixed = family.groupBy("f").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("c"))
    family, open_ = stored(family.join(mixed.filter("r <> s and c > 2").select("f"), "f"), f"{path}/families", n=F.count(F.lit(1)))
    if open_["n"]:
        diffs, _ = stored(differences(family, sets, percent), f"{path}/differences")
        best = diffs.groupBy("f").agg(F.max(F.struct("slack", "key")).alias("best"))
        sure = (diffs.join(best, "f").filter((F.col("slack") + F.col("best.slack") >= 0) & (F.col("key") != F.col("best.key")))
                .select(F.col("best.key").alias("a"), F.col("key").alias("b")))
        known = root.select(F.col("node").alias("a"), F.col("root").alias("b"))
        root = components(known.unionAll(sure), f"{path}/components2")
        more, found = stored(confirmed(sharing(diffs, best, root, percent), sets, percent), f"{path}/links2", n=F.count(F.lit(1)))
        if found["n"]:
            known = root.select(F.col("node").alias("a"), F.col("root").alias("b"))
            root = components(known.unionAll(more), f"{path}/components3")

    keyed = rows.join(root, F.col("key") == F.col("node"), "left").select("id", "n_shingles", *names, F.coalesce("root", "key").alias("root"))
    least = keyed.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("id").alias("least")).withColumnRenamed("root", "of")
    result = keyed.join(least, F.col("root") == F.col("of"), "left")
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return result.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
                         F.col("id").eqNullSafe(component).alias("kept"), *names)

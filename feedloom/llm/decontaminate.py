"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for every segment of the corpus (a few MB of whole
documents), the sorted positions of each term. ``search`` looks up every
window of a test item in every segment: starting from the window's rarest term
there, the posting lists of its other terms, shifted by their offsets, are
intersected in order of rarity. With ``slop`` 0 that finds exact phrases; a
larger slop lets every term stand that many places off (proximity). ``decontaminate``
reports both from one pass over the index: exact phrases decide, ``near_items`` tells which
items are close. Every word of the corpus is indexed, whatever the size of the benchmark.

The postings of a segment are one compressed value, which only the task that looks them up unpacks, one segment at a time: Spark
and the stored files (row groups of ``GROUP_BYTES``) never hold the terms of many segments as rows or arrays.

A segment holds whole documents, so neither the index nor the search shuffles
and a passage that a third of all documents share is only a longer posting
list in every segment. Test items travel to the tasks in blocks of bounded
size (``BLOCK_BYTES``); a larger benchmark takes several passes over the index.

Defined results: a null or empty text has no words and no hits; a null or
wordless item has no window; items with a null id count as items but carry no id;
repeated documents are reported one by one, repeated items count once; an
empty corpus or benchmark gives no hits; other columns are not read. A window and twice the slop
are at most ``GAP`` words together; more is an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, text_bytes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: every byte of a non-ASCII character is 0x80 or more
WINDOW = 10
SEGMENT_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20  # of test items in one pass; bounds what the tasks are sent
NEAR = 2  # places that a term may be off in the registered query's proximity matches
GAP = 64  # unused positions between documents, so no match crosses them
GROUP_BYTES = 4 << 20  # of a row group of the stored index; a reader holds a whole one
#: The values are compressed already; the writer looks at its size after every row, not after the first hundred.
STORED = {"compression": "none", "parquet.block.size": GROUP_BYTES, "parquet.enable.dictionary": "false",
          "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def packed_postings(terms: list[bytes], counts: np.ndarray, steps: np.ndarray) -> bytes:
    """The terms (words, so none holds a line break), how many positions each has, and the differences of these in turn."""
    raw = b"".join((len(terms).to_bytes(8, "little"), counts.astype("<i4").tobytes(), steps.astype("<i4").tobytes(), b"\n".join(terms)))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def postings(z: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """What ``packed_postings`` was given."""
    raw = pa.decompress(memoryview(z)[8:], decompressed_size=int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    counts = np.frombuffer(raw, "<i4", n, 8).astype(np.int64)
    total = int(counts.sum())
    steps = np.frombuffer(raw, "<i4", total, 8 + 4 * n).astype(np.int64)
    return raw[8 + 4 * (n + total):].split(b"\n") if n else [], counts, steps


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One row per segment: its documents and the positions of its terms."""
    kind = docs.schema[id_col].dataType.simpleString()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in by_bytes(batches, 1, segment_bytes):
            texts = [words(t) for t in text_bytes(b.column(1))]
            counts = np.array([len(w) for w in texts], np.int64)
            starts = np.concatenate([[0], np.cumsum(counts + GAP)[:-1]])
            code: dict[bytes, int] = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
            codes = np.fromiter(map(code.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
            place = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(codes))
            order = np.argsort(codes, kind="stable")
            n = np.bincount(codes, minlength=len(code))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(b.schema.field(0).type)),
                 pa.array([counts], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())),
                 pa.array([packed_postings(list(code), n, np.diff(place[order], prepend=0))], pa.binary())],
                names=["segment", "doc_ids", "doc_words", "doc_starts", "postings"])
            number += 1

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        segments, f"segment long, doc_ids array<{kind}>, doc_words array<bigint>, doc_starts array<bigint>, "
                  "postings binary")


def windows_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], set[str | None]]:
    """Distinct windows and the items that hold them."""
    out: dict[tuple[bytes, ...], set[str | None]] = {}
    for item, text in items:
        w = words((text or "").encode())
        for i in range(max(1, len(w) - window + 1) if w else 0):
            out.setdefault(tuple(w[i:i + window]), set()).add(item)
    return out


def locate(wins: np.ndarray, begin: np.ndarray, count: np.ndarray, place: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (window number, position p of its first word) of equally long windows of term codes: the window's
    term k stands at p + k - ``slop`` to p + k + ``slop``. Which term is looked up first doesn't change the result.

    ``place[begin[t]:begin[t] + count[t]]`` are the sorted positions of term t.
    """
    size = count[wins]
    live = np.flatnonzero((size > 0).all(axis=1))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(size[live], axis=1, kind="stable")
    rarest = wins[live, order[:, 0]]
    n = count[rarest]
    win = np.repeat(np.arange(len(live)), n)
    at = np.repeat(begin[rarest] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    start = place[at] - order[win, 0]
    if slop:  # the rarest term may itself be off its place
        off = np.arange(-slop, slop + 1)
        pairs = np.unique(np.stack([np.repeat(win, len(off)), (start[:, None] + off).ravel()]), axis=1)
        win, start = pairs[0], pairs[1]
    span = int(place.max()) + 2 * GAP + 2
    keys = np.repeat(np.arange(len(begin)), count) * span + place  # sorted: terms in turn, positions rising
    for k in range(1, wins.shape[1]):
        offset = order[win, k]
        term = wins[live[win], offset]
        low = term * span + np.maximum(start + offset - slop, 0)
        i = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
        ok = (keys[i] >= low) & (keys[i] <= term * span + start + offset + slop)
        win, start = win[ok], start[ok]
    return live[win], start


def search(index: DataFrame, items: list[tuple[str | None, str | None]], window: int = WINDOW, slop: int = 0, near: int = 0) -> DataFrame:
    """One row per document of the index: ``segment, doc_no, doc_id, n_words``, the merged word ranges
    ``runs`` inside occurrences, the ``items`` (sorted) whose windows occur, and ``near_items`` (sorted), whose windows occur
    with their terms at most ``near`` places off."""
    if window + 2 * max(slop, near) > GAP:
        raise ValueError(f"window and twice the slop are at most {GAP}")
    held = windows_of(items, window)
    by_length = {n: [w for w in held if len(w) == n] for n in sorted({len(w) for w in held})}
    every = [held[w] for wins in by_length.values() for w in wins]
    kind = dict(index.dtypes)["doc_ids"][len("array<"):-1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                yield one(b.slice(row, 1))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, n_words, starts, z = (b.column(i)[0] for i in range(1, 5))
        n_words, starts = (np.array(x.values, np.int64) for x in (n_words, starts))
        terms, count, steps = postings(z.as_py())
        place = np.cumsum(steps)
        number = {t: i + 1 for i, t in enumerate(terms)}
        count = np.concatenate([[0], count])  # term 0 is any that the segment lacks
        begin = np.cumsum(count) - count
        coded = [np.array([[number.get(t, 0) for t in w] for w in wins], np.int64) for wins in by_length.values()]

        def occurrences(off: int) -> tuple[np.ndarray, ...]:
            """Document, first and last word (exclusive) and window of every occurrence."""
            out, upto = [np.zeros((4, 0), np.int64)], 0
            for length, wins in zip(by_length, coded):
                if len(place):
                    w, start = locate(wins, begin, count, place, off)
                    doc = np.searchsorted(starts, start + off, "right") - 1
                    out.append(np.stack([doc, np.maximum(start - off, starts[doc]) - starts[doc],
                                         np.minimum(start + length + off - starts[doc], n_words[doc]), w + upto]))
                upto += len(wins)
            return tuple(np.concatenate(out, axis=1))

        def names(doc: np.ndarray, win: np.ndarray) -> pa.Array:
            found: list[set] = [set() for _ in n_words]
            for d, k in set(zip(doc.tolist(), win.tolist())):
                found[d] |= every[k]
            return pa.array([sorted(x for x in f if x is not None) for f in found], pa.list_(pa.string()))

        doc, first, last, win = occurrences(slop)
        runs: list[list] = [[] for _ in n_words]
        for i in np.lexsort((first, doc)):
            own = runs[doc[i]]
            if own and first[i] <= own[-1]["last"]:
                own[-1]["last"] = max(own[-1]["last"], int(last[i]))
            else:
                own.append({"first": int(first[i]), "last": int(last[i])})
        items_found = names(doc, win)
        if near != slop:
            doc, _, _, win = occurrences(near)
        run = pa.struct([("first", pa.int64()), ("last", pa.int64())])
        n = len(n_words)
        return pa.RecordBatch.from_arrays(
            [pa.array([b.column(0)[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int64()), ids.values,
             pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(run)), items_found, names(doc, win)],
            names=["segment", "doc_no", "doc_id", "n_words", "runs", "items", "near_items"])

    return index.select("segment", "doc_ids", "doc_words", "doc_starts", "postings").mapInArrow(
        look_up, f"segment long, doc_no long, doc_id {kind}, n_words long, "
                 "runs array<struct<first:bigint,last:bigint>>, items array<string>, near_items array<string>")


def covered(runs: Column) -> Column:
    """Words in the union of the ranges."""
    done = F.aggregate(
        F.array_sort(runs), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"], s["upto"]))).alias("n"),
                              F.greatest(s["upto"], r["last"]).alias("upto")))
    return done["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, index_path: str, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, near: int = 0) -> DataFrame:
    """``doc_id, n_words, n_hit, items, near_items, contaminated`` per document; ``near`` is the slop of ``near_items``. The index
    is stored at ``index_path``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("t", "i"), F.lit(blocks))
    build_index(docs).write.options(**STORED).parquet(index_path)
    index = spark.read.parquet(index_path)
    found = None
    for k in range(blocks):
        one = search(index, [tuple(r) for r in items.filter(part == k).collect()], window, near=near)
        found = one if found is None else found.unionAll(one)
    if blocks > 1:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("segment", "doc_no").agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("runs")).alias("runs"), merged("items"), merged("near_items"))
    return found.select("doc_id", "n_words", covered(F.col("runs")).alias("n_hit"), "items", "near_items",
                        (F.size("runs") > 0).alias("contaminated"))

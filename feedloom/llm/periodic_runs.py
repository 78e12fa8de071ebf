"""Periodic runs of words: stretches that repeat one block at least three times, found and folded.

A run is a stretch of at least ``max(SHORTEST, 3 * period)`` consecutive words
whose smallest period is ``period`` and that no neighbouring word extends.

1. *Recursive frequency splitting.* A word of a run occurs at least three times
   in it. So every word that occurs less often within the current segment cuts
   the segment; parts shorter than ``SHORTEST`` go, the others are counted anew,
   until nothing is cut. After a cut only the smaller parts are recounted and
   their counts taken from the largest part's, so a text of n words costs
   O(n log n) however deep the cuts nest. A run lies in one part as a whole.
2. *Lag scan* of the segments left, for every lag q up to a third of their
   length. The places where a run of period q equals itself q words on are at
   least 2q in a row, so they hold a whole block of q (more for short periods)
   that starts at a multiple of its size. Comparing the hashes of such blocks
   costs m/q per lag, m log m in all. Hashes only propose: each proposal is
   extended word by word to the whole stretch. Blocks inside a run found with a
   smaller lag have that run's period and are skipped.

``periodic_runs`` returns per row the number of words, all runs, the run of the
greatest length/period (ties: smallest start, then period) and the text with
every word dropped that lies in a run after that run's first period, words
joined by one space. Memory is that of one text: about 200 bytes a word of the
longest text.

Defined results: a null or empty text, or one of white space, has no words, no
runs and the empty text; a text shorter than ``SHORTEST`` words has no runs;
overlapping runs are all listed, and each drops its own words; repeated rows are
judged one by one; an empty table gives an empty result; columns other than id
and text are not read, so no column name can clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, mix64, text_bytes

SHORTEST, TIMES = 24, 3  # a run has at least SHORTEST words and TIMES periods
BATCH_BYTES = 4 << 20
PAIRS = 1 << 20  # adjacent blocks compared at a time

Run = tuple[int, int, int]  # start, length, period


def _parts(lo: int, hi: int, cuts: list[int]) -> list[tuple[int, int]]:
    """What the cut places leave of [lo, hi)."""
    edges = [lo - 1, *cuts, hi]
    return [(a + 1, b) for a, b in zip(edges, edges[1:]) if b > a + 1]


def segments(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int]]:
    """The stretches [lo, hi) in which every word occurs at least ``times`` times; every run lies in one of them."""
    if len(ids) < shortest:
        return []
    cuts = np.flatnonzero(np.bincount(ids)[ids] < times)
    edges = np.concatenate(([-1], cuts, [len(ids)]))
    work = [(int(edges[k]) + 1, int(edges[k + 1]), None, None) for k in np.flatnonzero(np.diff(edges) > shortest)]
    if not work:
        return []
    order = np.argsort(ids, kind="stable")
    first = np.searchsorted(ids[order], np.arange(int(ids.max()) + 2))
    out = []
    while work:
        lo, hi, counts, rare = work.pop()
        if counts is None:
            counts = Counter(ids[lo:hi].tolist())
            rare = [w for w, c in counts.items() if c < times]
        if not rare:
            out.append((lo, hi))
            continue
        cuts = []
        for w in rare:
            places = order[first[w]:first[w + 1]]
            k = bisect_left(places, lo)
            cuts += [int(p) for p in places[k:k + times] if p < hi]
        parts = _parts(lo, hi, sorted(cuts))
        largest = max(parts, key=lambda p: p[1] - p[0], default=(lo, lo))
        work += [(a, b, None, None) for a, b in parts if (a, b) != largest and b - a >= shortest]
        if largest[1] - largest[0] >= shortest:
            rare = set()
            for w in ids[lo:largest[0]].tolist() + ids[largest[1]:hi].tolist():
                counts[w] -= 1
                if counts[w] < times:
                    rare.add(w)
            work.append((*largest, counts, [w for w in rare if counts[w] > 0]))
    return sorted(out)


def _reach(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, going by ``step``, hold the word that stands ``lag`` places after them."""
    room = len(x) - lag - at if step > 0 else at + 1
    done, wide = 0, 64
    while done < room:
        n = min(wide, room - done)
        a = at + done if step > 0 else at - done - n + 1
        differ = np.flatnonzero(x[a:a + n] != x[a + lag:a + lag + n])
        if len(differ):
            return done + int(differ[0] if step > 0 else n - 1 - differ[-1])
        done, wide = done + n, wide * 2
    return room


def _blocks(m: int, shortest: int, times: int, pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lag, size of a block, its place) for all lags in ascending order, some ``pairs`` at a time.

    A run of period q holds at least t = max(shortest, times * q) - q places in a row that equal the place q further on,
    so it holds a whole block of (t + 1) // 2 of them that starts at a multiple of that size."""
    lag, top = 1, m // times
    size = lambda q: (np.maximum(shortest, times * q) - q + 1) // 2
    while lag <= top:
        last = min(top, lag + max(0, pairs // (m // int(size(lag)) + 1) - 1))
        lags = np.arange(lag, last + 1)
        n = np.maximum(0, (m - lags) // size(lags))
        q = np.repeat(lags, n)
        k = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
        yield q, size(q), k * size(q)
        lag = last + 1


def lag_scan(x: np.ndarray, shortest: int = SHORTEST, times: int = TIMES, pairs: int = PAIRS) -> list[Run]:
    """All runs of the words ``x``, by start and period."""
    m = len(x)
    value = mix64(x.astype(np.uint64) + np.uint64(1))
    power = np.full(m + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(m + 1, np.uint64)
    np.cumsum(value * power[:m], out=total[1:])
    runs: list[Run] = []
    starts: list[int] = []  # of the runs found so far, in order
    ends: list[int] = []  # the greatest end up to each of them
    for q, size, a in _blocks(m, shortest, times, pairs):
        same = (total[a + size] - total[a]) * power[q] == total[a + q + size] - total[a + q]
        q, size, a = q[same], size[same], a[same]
        if len(runs) and len(q):
            k = np.searchsorted(starts, a, "right") - 1
            free = (k < 0) | (np.array(ends)[k] < a + q + size)
            q, size, a = q[free], size[free], a[free]
        done_lag, done_to = 0, 0
        for lag, wide, at in zip(q.tolist(), size.tolist(), a.tolist()):
            if lag == done_lag and at + wide <= done_to:  # the same stretch of this lag
                continue
            k = bisect_right(starts, at) - 1
            if k >= 0 and ends[k] >= at + lag + wide:
                continue
            right, left = _reach(x, at, lag, 1), _reach(x, at - 1, lag, -1)
            done_lag, done_to = lag, at + right
            start, end = at - left, at + right + lag
            if end - start >= max(shortest, times * lag):
                runs.append((start, end - start, lag))
                k = bisect_right(starts, start)
                starts.insert(k, start)
                ends.insert(k, max(end, ends[k - 1] if k else 0))
                while (k := k + 1) < len(ends) and ends[k] < end:
                    ends[k] = end
    return sorted(runs)


def runs_of(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[Run]:
    """All runs of a text given as word numbers, by start, then period."""
    return sorted((lo + s, n, q) for lo, hi in segments(ids, shortest, times) for s, n, q in lag_scan(ids[lo:hi], shortest, times))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether a word stays: no run holds it after that run's first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step)[:n] == 0


def strongest(runs: list[Run]) -> Run | None:
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[object, int], np.ndarray | None] | None = None, shortest: int = SHORTEST,
                  times: int = TIMES) -> DataFrame:
    """``id, n_words, runs, strongest, collapsed`` per row.

    ``rewrite(id, n_words)`` may name for every place of a text the word that shall stand there
    (None: the text as it is).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    run = "struct<start:bigint,length:bigint,period:bigint>"
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(key, text: bytes) -> tuple:
        words = text.split()  # splits bytes at \x20 and \x09-\x0D, nothing else
        n = len(words)
        source = rewrite(key, n) if rewrite and n else None
        found: list[Run] = []
        if n >= shortest:
            number = dict(zip(dict.fromkeys(words), range(n)))
            ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
            found = runs_of(ids if source is None else ids[source], shortest, times)
        if source is not None:
            words = [words[k] for k in source.tolist()]
        if found:
            words = [words[k] for k in np.flatnonzero(kept_words(n, found)).tolist()]
        return n, found, strongest(found), b" ".join(words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH_BYTES):
            n, runs, best, kept = zip(*map(one, b.column(1).to_pylist(), text_bytes(b.column(0))))
            name = ("start", "length", "period")
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(n, pa.int64()), pa.array([[dict(zip(name, r)) for r in rs] for rs in runs], pa.list_(run_type)),
                 pa.array([r and dict(zip(name, r)) for r in best], run_type), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "runs", "strongest", "collapsed"])

    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias(id_col))
    return src.mapInArrow(work, f"`{id_col}` {kind}, n_words long, runs array<{run}>, strongest {run}, collapsed string")


def echo_plan(key, n: int) -> np.ndarray | None:
    """The registered query's planted runs, by the id: from word a = g mod n on the p words at a are repeated (h = crc32
    of the id in decimal, g = h // 10, p = 1 + (n - a) // (3 + g mod 8)), for ids with h mod 10 = 0. A null id has none."""
    from zlib import crc32

    h = crc32(str(key).encode()) if key is not None else 1
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + np.arange(n - a) % p
    return source

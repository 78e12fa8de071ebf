"""Exact substring dedup by prefix-free parsing.

``Parse``: a rolling hash runs over each text; the positions whose hash is the
smallest among all ``SPAN - TRIGGER + 1`` triggers of a ``SPAN``-byte string are
the triggers of that string, and a maximal run of strings with one trigger hash is
a phrase. Phrases overlap by ``SPAN - 1`` bytes, so every ``SPAN``-byte string lies in
exactly one phrase (the parse is prefix-free), and equal strings always have equal
triggers. Repetitive text therefore shrinks to few distinct phrases (the dictionary).

Order: the phrases of triggers that more than one document holds form the dictionary, one part per hash bucket of triggers.
Equal phrases are one entry; the parse is the list of an entry's places with their documents. The suffixes of a part's entries are
sorted by their first ``SPAN`` bytes. As no string goes beyond its phrase, suffixes of equal rank have equal parses too,
so the rank of a string in the corpus is its rank in the dictionary; the parse says which documents hold it.

Hashes only choose where bytes are compared: equality is always decided on the bytes, in a section and in a part of the dictionary.

Work is shipped as packed arrays per section of the input (``SECTION_BYTES``) and
hash bucket. Inside a section, copies of a phrase are reduced to the smallest
document and a trigger has one entry, so a passage shared by a third of all
documents adds one entry per section and trigger.

Defined results: a null or empty text has 0 bytes; ids are integers, a null id is
larger than any other, rows with equal ids never remove each other's bytes; repeated rows
are treated alike; an empty table gives an empty result; other columns are not read. The input
has to be a stored table (its rows come in the same order when read again); if they do not, the
chunk check raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, mix64, text_bytes
from .components import stored
from .shingles import Powers

SPAN = 50
TRIGGER = 20
CHUNK_BYTES = 1 << 20  # texts handled together in numpy
# Texts whose phrases are reduced before they are shipped, and texts per hash bucket. A task needs about 15 times as
# much memory; on large executors both are raised together, so that a section has many entries for each bucket.
SECTION_BYTES = 8 << 20
BUCKET_BYTES = 12 << 20
GROUPS = 16  # parts of a bucket's dictionary that are sorted one by one
PIECE = 1024  # strings of a phrase that are one entry of the dictionary; longer phrases are several
LAST = np.iinfo(np.int64).max  # order of a null id

_POWERS = Powers(0xD1342543DE82EF95)
_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xABCD1234))


def _pack(x: np.ndarray) -> bytes:
    """Differences of integers, compressed (4 bytes each where they fit)."""
    d = np.diff(x.astype(np.int64), prepend=0)
    small = len(d) == 0 or (abs(d).max() < 1 << 31)
    raw = d.astype(np.int32 if small else np.int64).tobytes()
    return bytes([int(small)]) + len(raw).to_bytes(5, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    raw = pa.decompress(b[6:], decompressed_size=int.from_bytes(b[1:6], "little"), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int32 if b[0] else np.int64).astype(np.int64))


class Parse:
    """The phrases of the texts of a chunk; positions are bytes from the chunk's start."""

    def __init__(self, texts: list[bytes], span: int = SPAN, trigger: int = TRIGGER):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(size)
        n = len(buf)
        self.span = span
        empty = np.zeros(0, np.int64)
        self.begin = self.count = self.doc = empty
        self.trigger = np.zeros(0, np.uint64)
        if n < span:
            return
        up, down = _POWERS.to(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[:-1], out=total[1:])
        low = mix64((total[trigger:] - total[:-trigger]) * down[:n + 1 - trigger])
        wide, have = span - trigger + 1, 1
        while have * 2 <= wide:
            low, have = np.minimum(low[:-have], low[have:]), have * 2
        if have < wide:
            low = np.minimum(low[:len(low) - (wide - have)], low[wide - have:])
        doc = np.repeat(np.arange(len(texts)), size)[:len(low)]
        at = np.flatnonzero(np.arange(len(low)) + span <= self.ends[doc])
        if not len(at):
            return
        low, doc = low[at], doc[at]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.append(first[1:], len(at))
        self.begin, self.count, self.doc, self.trigger = at[first], last - first, doc[first], low[first]

    def strings(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and phrase of every ``span``-byte string of the phrases."""
        n = self.count[phrases]
        upto = np.cumsum(n)
        start = np.repeat(self.begin[phrases] - (upto - n), n) + np.arange(int(n.sum()))
        return start, np.repeat(phrases, n)

    def pieces(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of strings and phrase of the pieces of the phrases."""
        n = -(-self.count[phrases] // PIECE)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        own = np.repeat(phrases, n)
        return self.begin[own] + step * PIECE, np.minimum(PIECE, self.count[own] - step * PIECE), own

    def strings_from(self, begin: np.ndarray) -> np.ndarray:
        """The number of strings of the pieces that begin there."""
        own = np.searchsorted(self.begin, begin, "right") - 1
        return np.minimum(PIECE, self.begin[own] + self.count[own] - begin)


def _order(ids: list) -> np.ndarray:
    return np.array([LAST if i is None else i for i in ids], np.int64)


def _check(ids: np.ndarray, texts: list[bytes]) -> bytes:
    """Names a chunk's content."""
    h = hashlib.blake2b(ids.tobytes(), digest_size=12)
    h.update(np.array([len(t) for t in texts], np.int64).tobytes())
    for t in texts:
        h.update(t)
    return h.digest()


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list, list[bytes]]]:
    """Chunk number, order of the ids, the ids, the texts. Equal for every reading of the same stored table."""
    number = TaskContext.get().partitionId() << 32
    for b in by_bytes(batches, 1, CHUNK_BYTES):
        ids = b.column(0).to_pylist()
        yield number, _order(ids), ids, text_bytes(b.column(1))
        number += 1


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first key first), and where a new value of the first key begins in that order."""
    order = np.lexsort(keys[::-1])
    k = keys[0][order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


def parse_sections(docs: DataFrame, buckets: int, section_bytes: int) -> DataFrame:
    """``bucket, head, chunks, at, docs, triggers, mixed, gone, open``: a section's triggers per bucket.

    For every trigger hash of a section: if all its phrases are equal, the smallest document's places of the
    phrase; else a mark that they differ. Phrases that a smaller document of the section holds too are settled
    here (``gone``); the remaining phrases of mixed triggers are listed as ``open``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, Parse, np.ndarray, bytes]] = []
        size = 0
        for number, order, _, texts in chunks(batches):
            held.append((number, _check(order, texts), Parse(texts), order, b"".join(texts)))
            size += len(held[-1][4])
            if size >= section_bytes:
                yield section(held, buckets)
                held, size = [], 0
        if held:
            yield section(held, buckets)

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{c} binary" for c in PARTS[1:]))


PARTS = ["bucket", "head", "chunks", "at", "docs", "triggers", "mixed", "gone", "open"]


def section(held: list[tuple[int, bytes, Parse, np.ndarray, bytes]], buckets: int) -> pa.RecordBatch:
    """The rows of one section; ``held`` lists its chunks: number, check, parse, order of the ids, bytes."""
    starts = np.cumsum([0] + [len(p.begin) for _, _, p, _, _ in held])
    trigger = np.concatenate([p.trigger for _, _, p, _, _ in held])
    doc = np.concatenate([ids[p.doc] for _, _, p, ids, _ in held])
    order, first = _first_of(trigger)
    n = np.diff(np.append(first, len(order)))
    again = np.sort(order[np.repeat(n > 1, n)])  # phrases whose trigger is met more than once: told apart by their bytes
    names: dict[bytes, int] = {}
    phrase = np.zeros(len(trigger), np.int64)
    for k, (_, _, p, _, raw) in enumerate(held):
        own = again[slice(*np.searchsorted(again, starts[k:k + 2]))]
        begin = p.begin[own - starts[k]]
        end = begin + p.count[own - starts[k]] + p.span - 1
        phrase[own] = [names.setdefault(raw[a:b], len(names)) for a, b in zip(begin.tolist(), end.tolist())]
    del names
    order, first = _first_of(trigger, phrase, doc)
    t, x, d = trigger[order], phrase[order], doc[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])]) if len(t) else np.zeros(0, bool)
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(t) else d
    gone, own_ = order[d > least], d == least  # a document may hold a phrase several times
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    several = (np.bincount(group[new], minlength=len(first)) > 1)[group]
    open_ = order[own_ & several]
    head = np.zeros(len(t), bool)
    head[first] = True
    ship = np.where(several, head, own_)
    single, mixed = order[ship], several[ship]
    bucket = (trigger[single] >> np.uint64(40)) % np.uint64(buckets)
    by = np.lexsort((single, bucket))
    single, mixed, bucket = single[by], mixed[by], bucket[by]
    own = np.array([hash_bucket(h[0], buckets) for h in held])
    rows = []
    for b in range(buckets) if buckets < len(single) else np.unique(np.concatenate([bucket.astype(np.int64), own])):
        lo, hi = np.searchsorted(bucket, [b, b + 1])
        if hi > lo:
            s, m = single[lo:hi], mixed[lo:hi]
            low5 = trigger[s].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((int(b), _pack(starts[:-1]), _pack(np.array([h[0] for h in held])), _pack(s), _pack(doc[s]), low5.tobytes(),
                         np.packbits(m).tobytes(), None, None))
    for k, (number, check, _, _, _) in enumerate(held):
        inside = lambda a: np.sort(a[(a >= starts[k]) & (a < starts[k + 1])]) - starts[k]  # noqa: B023, E731
        rows.append((int(own[k]), check, _pack(np.array([number])), None, None, None, None, _pack(inside(gone)), _pack(inside(open_))))
    kinds = [pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=PARTS)


def hash_bucket(number: int, buckets: int) -> int:
    return int(mix64(np.array([number], np.uint64))[0] % np.uint64(buckets))


def _settled(out: list[tuple[int, bytes | None, str, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "check": pa.array([o[1] for o in out], pa.binary()),
                     "kind": pa.array([o[2] for o in out], pa.string()), "places": pa.array([o[3] for o in out], pa.binary())})


def settle_triggers(table: pa.Table) -> pa.Table:
    """A bucket's entries -> ``chunk, check, kind, places``: phrases that are gone, and phrases that have to be compared (``open``)."""
    out: list[tuple[int, bytes | None, str, bytes]] = []
    t_, d_, m_, c_, p_ = [], [], [], [], []
    for r in table.to_pylist():
        if r["at"] is None:
            chunk = int(_unpack(r["chunks"])[0])
            out += [(chunk, r["head"], "gone", r["gone"]), (chunk, r["head"], "open", r["open"])]
            continue
        starts, numbers, at = _unpack(r["head"]), _unpack(r["chunks"]), _unpack(r["at"])
        which = np.searchsorted(starts, at, "right") - 1
        # a chunk without phrases starts where the next one does; the last of equal starts holds the phrase
        low = np.zeros((len(at), 8), np.uint8)
        low[:, :5] = np.frombuffer(r["triggers"], np.uint8).reshape(-1, 5)
        t_.append(low.view("<u8").ravel())
        d_.append(_unpack(r["docs"]))
        m_.append(np.unpackbits(np.frombuffer(r["mixed"], np.uint8), count=len(at)).astype(bool))
        c_.append(numbers[which])
        p_.append(at - starts[which])
    if t_:
        t, d, m, c, p = (np.concatenate(a) for a in (t_, d_, m_, c_, p_))
        order, first = _first_of(t)
        d, m, c, p = (a[order] for a in (d, m, c, p))
        n = np.diff(np.append(first, len(order)))
        # a mixed trigger stands for documents that are not named
        shared = np.logical_or.reduceat(m, first) | (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first))
        pick = np.repeat(shared, n) & ~m
        out += _by_chunk(c[pick], p[pick], "open")
    return _settled(out)


def _by_chunk(chunk: np.ndarray, place: np.ndarray, kind: str) -> list[tuple[int, None, str, bytes]]:
    order, first = _first_of(chunk, place)
    chunk, place = chunk[order], place[order]
    return [(int(chunk[a]), None, kind, _pack(place[a:b])) for a, b in zip(first, np.append(first[1:], len(chunk)))]


def _places(rows: list[dict], kind: str) -> np.ndarray:
    found = [_unpack(r["places"]) for r in rows or [] if r["kind"] == kind]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def stored_chunks(docs: DataFrame) -> DataFrame:
    """``chunk, check, ids, sizes, texts``: a chunk's texts compressed together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, order, ids, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([_check(order, texts)], pa.binary()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary())],
                names=["chunk", "check", "ids", "sizes", "texts"])

    return docs.mapInArrow(run, "chunk long, check binary, ids array<bigint>, sizes array<bigint>, texts binary")


def _texts(r: dict) -> list[bytes]:
    raw = pa.decompress(r["texts"], decompressed_size=sum(r["sizes"]), codec="zstd", asbytes=True) if sum(r["sizes"]) else b""
    ends = np.cumsum(r["sizes"])
    for x in r["found"] or []:
        if x["check"] is not None and x["check"] != r["check"]:
            raise ValueError("the input's rows came in another order when read again; store it first")
    return [raw[e - n:e] for e, n in zip(ends, r["sizes"])]


def open_phrases(joined: DataFrame, buckets: int) -> DataFrame:
    """``bucket, chunk, cuts, strings, docs, begins, raw``: the bytes of the open phrases of a chunk, by bucket and group of triggers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                todo = _places(r["found"], "open")
                if not len(todo):
                    continue
                texts = _texts(r)
                rows = phrase_rows(r["chunk"], Parse(texts), _order(r["ids"]), b"".join(texts), todo, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=ENTRIES)

    return joined.mapInArrow(run, "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in ENTRIES[2:]))


ENTRIES = ["bucket", "chunk", "cuts", "strings", "docs", "begins", "raw"]
KINDS = [pa.int32(), pa.int64()] + [pa.binary()] * 5


def phrase_rows(chunk: int, p: Parse, order: np.ndarray, raw: bytes, phrases: np.ndarray, buckets: int) -> list[tuple]:
    begin, count, own = p.pieces(phrases)
    doc, trigger = order[p.doc[own]], p.trigger[own]
    bucket = (trigger >> np.uint64(40)) % np.uint64(buckets)
    group = (trigger >> np.uint64(20)) % np.uint64(GROUPS)
    by = np.lexsort((begin, group, bucket))
    begin, count, doc, bucket, group = (a[by] for a in (begin, count, doc, bucket, group))
    ends = (begin + count + p.span - 1).tolist()
    starts = begin.tolist()
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
    rows = []
    for s, e in zip(cuts, cuts[1:]):
        joined = b"".join([raw[a:z] for a, z in zip(starts[s:e], ends[s:e])])
        rows.append((int(bucket[s]), chunk, _pack(np.searchsorted(group[s:e], np.arange(GROUPS + 1))), _pack(count[s:e]), _pack(doc[s:e]),
                     _pack(begin[s:e]), pa.compress(joined, codec="zstd", asbytes=True)))
    return rows


def settle_phrases(table: pa.Table) -> pa.Table:
    """A bucket's phrases -> ``chunk, check, kind, places``: starts of pieces (``piece``) and of strings (``string``) that a smaller document holds too."""
    rows = []
    for r in table.to_pylist():
        count = _unpack(r["strings"])
        ends = np.cumsum(count + SPAN - 1)
        raw = pa.decompress(r["raw"], decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
        rows.append((r["chunk"], _unpack(r["cuts"]).tolist(), count, ends, _unpack(r["docs"]), _unpack(r["begins"]), raw))
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"piece": [], "string": []}
    for g in range(GROUPS):
        names: dict[bytes, int] = {}
        entry, c_, d_, p_ = [], [], [], []
        for chunk, cuts, count, ends, docs, begins, raw in rows:
            own = slice(cuts[g], cuts[g + 1])
            entry += [names.setdefault(raw[e - n:e], len(names)) for e, n in zip(ends[own].tolist(), (count[own] + SPAN - 1).tolist())]
            c_.append(np.full(cuts[g + 1] - cuts[g], chunk, np.int64))
            d_.append(docs[own])
            p_.append(begins[own])
        if entry:
            for kind, places in zip(found, settle_dictionary(list(names), np.array(entry), *(np.concatenate(a) for a in (c_, d_, p_)))):
                found[kind].append(places)
    return _settled([row for kind, f in found.items() if f for row in _by_chunk(*(np.concatenate(a) for a in zip(*f)), kind)])


def suffix_ranks(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of at least ``SPAN`` bytes of all entries, sorted by their first ``SPAN`` bytes: entry and offset of each suffix, the
    sorted order, and where in that order a new string begins."""
    size = np.array([len(e) for e in entries], np.int64)
    count = size - SPAN + 1
    owner = np.repeat(np.arange(len(entries)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    text = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(entries), np.uint8), SPAN)
    suffix = np.ascontiguousarray(text[(np.cumsum(size) - size)[owner] + offset]).view(f"S{SPAN}").ravel()
    order = np.argsort(suffix, kind="stable")
    suffix = suffix[order]
    return owner, offset, order, np.flatnonzero(np.concatenate([[True], suffix[1:] != suffix[:-1]]))


def settle_dictionary(entries: list[bytes], entry: np.ndarray, chunk: np.ndarray, doc: np.ndarray,
                      begin: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Chunk and start of the pieces, and of the strings of other pieces, that go of a part of the dictionary. ``entry, chunk, doc, begin``
    is its parse: where which entry stands."""
    least = np.full(len(entries), LAST)
    np.minimum.at(least, entry, doc)
    whole = doc > least[entry]
    owner, offset, order, first = suffix_ranks(entries)
    holder = least[owner]
    low = np.repeat(np.minimum.reduceat(holder[order], first), np.diff(np.append(first, len(order))))
    gone = np.sort(order[holder[order] > low])
    n_gone = np.bincount(owner[gone], minlength=len(entries))
    rest = np.flatnonzero(~whole)
    n = n_gone[entry[rest]]
    at = np.repeat(rest, n)
    k = np.arange(int(n.sum())) + np.repeat((np.cumsum(n_gone) - n_gone)[entry[rest]] - (np.cumsum(n) - n), n)
    return (chunk[whole], begin[whole]), (chunk[at], begin[at] + offset[gone[k]])


def removed_runs(p: Parse, phrases: np.ndarray, pieces: np.ndarray, strings: np.ndarray, size: int) -> np.ndarray:
    """Marks the chunk's bytes that are covered by whole phrases, pieces of phrases (by their starts) and strings."""
    step = np.zeros(size + 1, np.int64)
    for begin, count in ((p.begin[phrases], p.count[phrases]), (pieces, p.strings_from(pieces)), (strings, 1)):
        np.add.at(step, begin, 1)
        np.add.at(step, begin + count + p.span - 1, -1)
    return np.cumsum(step[:-1]) > 0


def cut(joined: DataFrame, id_col: str, kind: str, with_text: bool) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``text_crc32, text_sha256, kept_text``) per row."""
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text_crc32", "text_sha256", "kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                texts = _texts(r)
                mark = removed_runs(Parse(texts), *(_places(r["found"], k) for k in ("gone", "piece", "string")), sum(r["sizes"]))
                rows, end = [], 0
                for key, t in zip(r["ids"], texts):
                    m, end = mark[end:end + len(t)], end + len(t)
                    n = int(m.sum())
                    kept = np.frombuffer(t, np.uint8)[~m].tobytes() if n else t
                    spans = int((np.diff(m.astype(np.int8), prepend=0) == 1).sum()) if n else 0
                    rows.append((key, len(t), n, spans, hashlib.sha256(kept).hexdigest(), *([zlib.crc32(t), hashlib.sha256(t).digest(), kept.decode("utf-8", "ignore")] if with_text else [])))
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64(), pa.binary(), pa.string()] * with_text
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    text = ", text_crc32 long, text_sha256 binary, kept_text string" if with_text else ""
    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{text}")


def substring_dedup(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
                    section_bytes: int | None = None, bucket_bytes: int | None = None) -> DataFrame:
    """Remove every byte covered by a ``SPAN``-byte string that starts in a document with a smaller id too.

    ``with_text`` adds the kept bytes as text (bytes of a character that was cut are left out) and the CRC-32 and SHA-256 of
    the whole text, which tell rows with equal ids apart.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    total = src.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, total // (bucket_bytes or BUCKET_BYTES))
    settled = "chunk long, check binary, kind string, places binary"
    first, _ = stored(parse_sections(src, buckets, section_bytes or SECTION_BYTES).groupBy("bucket").applyInArrow(settle_triggers, settled), f"{path}/phrases")
    own = stored_chunks(src).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    listed = lambda f: f.groupBy("chunk").agg(F.collect_list(F.struct("check", "kind", "places")).alias("found"))  # noqa: E731  bounded by the chunk
    # both joins keep every chunk, so the one exchange of the texts serves both
    todo = own.join(listed(first.filter("kind = 'open'")), "chunk", "left")
    second = open_phrases(todo.select("chunk", "check", "ids", "sizes", "texts", "found"), buckets).groupBy("bucket").applyInArrow(settle_phrases, settled)
    every = listed(first.filter("kind = 'gone'").unionByName(second))
    return cut(own.join(every, "chunk", "left").select("chunk", "check", "ids", "sizes", "texts", "found"), id_col, "long", with_text)

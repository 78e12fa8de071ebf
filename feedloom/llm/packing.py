"""Cost-balanced packing of documents into training sequences.

A document's cost is estimated as linear plus quadratic in its tokens (the
quadratic part is attention, which stays inside a document). Every task packs
the documents of its own input split in chunks of bounded size, so there is no
shuffle and no group can grow hot: documents are taken in descending length and
each goes to the sequence of lowest cost that has token capacity left. Where a
document does not fit, it is cut and its rest goes on to the next sequence.
The capacities of a chunk add up to its tokens exactly (full sequences and
powers of two), so nothing is padded.

Defined results: a null or empty text is the end id alone (one piece of one
token); repeated rows are packed once each, also if their ids are equal or null;
an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import sys
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes

SEQUENCE = 2048
END_ID = 1
CHUNK_TOKENS = 1 << 22  # documents packed together: 4M tokens, 16 MB of ids
BATCH_BYTES = 4 << 20
MEMO_WORDS = 400_000  # words whose ids a task remembers; then it starts anew
JOINED = 256  # unseen words given to the tokenizer as one text
LINEAR, QUADRATIC = 1.0, 1.0 / SEQUENCE

# Of Latin-1: lower case, and 1 for a letter, 2 for white space, 3 for a comma or full stop.
LOWER = "".join(c.lower() if len(c.lower().encode("latin-1", "replace")) == 1 and ord(c.lower()) < 256 else c for c in map(chr, range(256))).encode("latin-1")
KIND = np.array([1 if c.isalpha() else 2 if c.isspace() else 3 if c in ",." else 0 for c in map(chr, range(256))], np.uint8)

_LOADED: dict[str, "WordIds"] = {}


class Memo(dict):
    """Word -> number in order of first sight; ``new`` lists the words not yet learned."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Ids of texts by a lower-casing tokenizer whose words never cross white space.

    A text's ids are those of its white-space separated words in turn, so each
    distinct word goes through the library once and its ids are remembered. A comma or
    full stop between a letter and white space is a word of its own (checked on the vocabulary), so far
    fewer words are distinct. A text with a character that Python takes for white space and
    the tokenizer doesn't is encoded whole.
    """

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model.decode())
        self.tok.no_truncation()
        self.tok.no_padding()
        one = self._whole("a b")
        spaces = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
        self.odd = [c for c in spaces if self._whole(f"a{c}b") != one or self._whole(f"{c}a{c}") != self._whole("a")]
        latin = [chr(c) for c in range(256) if chr(c) not in self.odd]
        self.lowers = all(self._whole(c) == self._whole(c.lower()) for c in latin)
        self.splits = all(self._whole(c + p) == self._whole(c) + self._whole(p) for c in latin if c.isalpha() for p in ",.")
        self._clear()

    def _clear(self) -> None:
        self.code = Memo()
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)  # of a word's ids in flat
        self.size = np.zeros(0, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self) -> None:
        """Ids of the words met since the last call."""
        new, self.code.new = self.code.new, []
        first = len(self.start)  # the new words' numbers follow each other
        flat, size = [self.flat], []
        groups = [new[i:i + JOINED] for i in range(0, len(new), JOINED)]
        for group, e in zip(groups, self.tok.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            begin = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e))[::2]
            width = np.fromiter(map(len, group), np.int64, len(group)) + 1
            size.append(np.diff(np.searchsorted(begin, np.cumsum(width), "left"), prepend=0))
            flat.append(np.array(e.ids, np.uint32))
        self.size = np.concatenate([self.size, *size])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(flat)
        assert len(self.size) == first + len(new)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words in turn, and where each word's ids end."""
        n = self.size[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.repeat(self.start[codes] - upto[:-1], n) + np.arange(upto[-1])], upto

    def _words(self, text: str) -> list[str]:
        """The white-space separated words; in Latin-1 texts without a special token's opening in lower case, where that
        changes no id, and with commas and full stops between a letter and white space apart."""
        if not self.lowers or "<|" in text:
            return text.split()
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split()
        raw = raw.translate(LOWER)
        if self.splits and raw:
            x = np.frombuffer(raw, np.uint8)
            kind = KIND[x]
            mark = kind == 3
            mark[1:] &= kind[:-1] == 1
            mark[:-1] &= kind[1:] == 2
            mark[0] = False
            apart = np.full(len(x) + int(mark.sum()), 32, np.uint8)
            apart[np.arange(len(x)) + np.cumsum(mark)] = x
            raw = apart.tobytes()
        return raw.decode("latin-1").split()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, without special tokens."""
        odd = {i: np.array(self._whole(t), np.uint32) for i, t in enumerate(texts) if any(c in t for c in self.odd)}
        words = [[] if i in odd else self._words(t) for i, t in enumerate(texts)]
        counts = [len(w) for w in words]
        if len(self.code) > MEMO_WORDS:
            self._clear()
        codes = np.fromiter(map(self.code.__getitem__, chain.from_iterable(words)), np.int64, sum(counts))
        if self.code.new:
            self._learn()
        every, upto = self._gather(codes)
        edges = upto[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return [odd[i] if i in odd else every[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def word_ids(model: bytes) -> WordIds:
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordIds(model)
    return _LOADED[key]


def capacities(tokens: int, sequence: int) -> list[int]:
    """Sequences that hold exactly ``tokens``: full ones, and powers of two for the rest."""
    rest = tokens % sequence
    return [sequence] * (tokens // sequence) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)``; sequences count from 0, offsets leave no gap."""
    room = capacities(sum(lengths), sequence)
    full = [(i, k * sequence) for i, n in enumerate(lengths) for k in range(n // sequence)]
    out = [(i, start, sequence, s, 0) for s, (i, start) in enumerate(full)]  # as costly as a sequence can be
    used = [sequence] * len(full) + [0] * (len(room) - len(full))
    open_ = [(0.0, s) for s in range(len(full), len(room))]
    heapq.heapify(open_)
    for i in sorted(range(len(lengths)), key=lambda i: (-(lengths[i] % sequence), i)):
        start, left = lengths[i] - lengths[i] % sequence, lengths[i] % sequence
        while left:
            c, s = heapq.heappop(open_)
            n = min(left, room[s] - used[s])
            out.append((i, start, n, s, used[s]))
            used[s] += n
            if used[s] < room[s]:
                heapq.heappush(open_, (c + cost(n), s))
            start, left = start + n, left - n
    return out


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE,
         end_id: int = END_ID, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``sequence_id`` holds the input split's number in its upper half, so a task
    that runs again after a lost executor gives the same ids.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(keys: list, ids: list[np.ndarray], base: int, arrow: pa.DataType) -> tuple[pa.RecordBatch, int]:
        pieces = assign([len(x) for x in ids], sequence)
        doc = [p[0] for p in pieces]
        cols = [pa.array([keys[i] for i in doc], arrow), pa.array([p[1] for p in pieces], pa.int64()),
                pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(ids[p[0]][p[1]:p[1] + p[2]]) for p in pieces], pa.int64()),
                pa.array([len(ids[i]) for i in doc], pa.int64()), pa.array([base + p[3] for p in pieces], pa.int64()),
                pa.array([p[4] for p in pieces], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=names), base + 1 + max(p[3] for p in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base = word_ids(model), TaskContext.get().partitionId() << 32
        try:
            yield from pieces_of(batches, words, base)
        finally:
            words._clear()  # the worker lives on for tasks of other stages

    def pieces_of(batches: Iterator[pa.RecordBatch], words: WordIds, base: int) -> Iterator[pa.RecordBatch]:
        keys, ids, tokens = [], [], 0
        for b in by_bytes(batches, 1, BATCH_BYTES):
            keys += b.column(0).to_pylist()
            for x in words.ids([t or "" for t in b.column(1).to_pylist()]):
                ids.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                tokens += len(ids[-1])
            if tokens >= chunk_tokens:
                out, base = rows(keys, ids, base, b.schema.field(0).type)
                yield out
                keys, ids, tokens = [], [], 0
        if ids:
            yield rows(keys, ids, base, b.schema.field(0).type)[0]

    src = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                               "sequence_id long, offset long")

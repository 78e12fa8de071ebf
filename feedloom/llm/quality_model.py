"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

``features`` computes the statistics of whole texts in an Arrow function;
``train`` fits on a bounded sample of labelled rows (``MAX_ROWS``, the rows of
smallest id hash, so the sample does not depend on the layout); ``score`` walks
all trees as flat arrays, a whole batch at a time with numpy.

Defined results: a null or empty text has all statistics 0 and is scored like
any other; a null label leaves a row out of the training; without labels of both
kinds every score is the share of label 1 (0.5 without any); a null id is never
trained on; repeated rows are scored one by one; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes, text_bytes

MAX_ROWS = 20_000  # labelled rows the model is fitted on, at most
FOLDS = 5
CUT = 0.3
TREES, DEPTH, RATE, BINS, LEAST, L2 = 80, 4, 0.15, 64, 20.0, 1.0
BATCH_BYTES = 4 << 20
BLOCK = 1 << 16  # bytes compressed at a time

CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b".", b",", b"!", b"?",
           b"|", b"#*$%&<>", b"\"'`;:()[]{}-_/\\+=@^~", bytes(range(128, 256))]
_CLASS = np.zeros((256, len(CLASSES)))
for _k, _c in enumerate(CLASSES):
    _CLASS[list(_c), _k] = 1
ENDS = (b".", b"!", b"?", b'"', b":")
RUN = re.compile(rb"[!?#*$%&|<>]{2,}")
NAMES = ["log_bytes", "log_words", "word_bytes", "distinct_words", "echoed_words", "distinct_triples", "log_lines", "line_words",
         "distinct_lines", "ended_lines", "short_lines", "symbol_runs", "compressed"] + [f"class_{k}" for k in range(len(CLASSES))]


def statistics(text: bytes) -> list[float]:
    if not text:
        return [0.0] * len(NAMES)
    n = len(text)
    words = text.split()
    m = max(1, len(words))
    lines = [s for x in text.split(b"\n") if (s := x.strip())]
    k = max(1, len(lines))
    triples = max(1, len(words) - 2)
    packed = sum(len(zlib.compress(text[i:i + BLOCK], 1)) for i in range(0, n, BLOCK))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
    return [np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / m, len(set(words)) / m, sum(map(eq, words, words[1:])) / m,
            len(set(zip(words, words[1:], words[2:]))) / triples, np.log1p(len(lines)), m / k, len(set(lines)) / k,
            sum(x.endswith(ENDS) for x in lines) / k, sum(len(x) < 30 for x in lines) / k, len(RUN.findall(text)) / m, packed / n, *shares]


def matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(NAMES))


@dataclass(frozen=True)
class Model:
    """Complete trees of one depth: inner node i of a tree has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes); a value above goes right
    leaf: np.ndarray  # (trees, leaves)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:  # every row is at the same depth
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Gradient-boosted trees with logistic loss; splits are sought on histograms of ``BINS`` quantile bins."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    inner = (1 << depth) - 1
    if len(np.unique(y)) < 2:
        return Model(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    out_f, out_c, out_l = [], [], []
    total = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            best = np.zeros(wide)
            chosen = np.full(wide, -1)
            where = np.zeros(wide, np.int64)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * BINS + binned[:, f]
                hist = [np.bincount(cell, w, wide * BINS).reshape(wide, BINS) for w in (g, h, None)]
                (gl, hl, nl) = (np.cumsum(a, 1)[:, :len(e)] for a in hist)
                gt, ht, nt = (a.sum(1, keepdims=True) for a in hist)
                gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
                gain = np.where((nl >= LEAST) & (nt - nl >= LEAST), gain, 0)
                top = gain.argmax(1)
                value = gain[np.arange(wide), top]
                better = value > best + 1e-9
                best, chosen, where = np.where(better, value, best), np.where(better, f, chosen), np.where(better, top, where)
            for i in np.flatnonzero(chosen >= 0):
                feature[first + i], cut[first + i] = chosen[i], edges[chosen[i]][where[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + L2)
        total += leaf[at]
        out_f.append(feature), out_c.append(cut), out_l.append(leaf)
    return Model(base, np.array(out_f), np.array(out_c), np.array(out_l))


def fold(id_col: Column) -> Column:
    """0 marks the held-out rows."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def features(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``x``, the statistics of the text."""
    types = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH_BYTES):
            x = matrix(text_bytes(b.column(0)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*keep, "x"])

    from pyspark.sql.types import ArrayType, DoubleType

    return docs.select(F.col(text_col).cast("string").alias("_text"), *keep).mapInArrow(run, types.add("x", ArrayType(DoubleType())))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold; at most ``max_rows`` rows of statistics reach the driver."""
    rows = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y"))
            .filter(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (fold(F.col("_id")) != 0)).distinct()
            .orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y").limit(max_rows))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(rows), "_id")
    data = features(own, "_t", ("_id", "_y")).orderBy(F.xxhash64(F.col("_id").cast("string")), "_id", "_y").limit(max_rows).toArrow()
    x = np.array(data.column("x").to_pylist(), np.float64).reshape(data.num_rows, len(NAMES))
    return fit(x, data.column("_y").to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``id, held_out, score, predicted`` per row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH_BYTES):
            s = model.score(matrix(text_bytes(b.column(0))))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                                             names=[id_col, "held_out", "score", "predicted"])

    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias(id_col), (fold(F.col(id_col)) == 0).alias("_h"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")

"""Language identification: spans of mixed-language text from per-word scores.

*Model.* Lower-cased text is read as words, runs of letters and marks. Per
language the training counts every three neighbouring code points (the word's edge
counts as one) in ``BINS`` hashed bins, and its letters per script. Counts are
taken over all training rows in Arrow functions and added up in Spark; what the
driver gets is languages x (BINS + scripts) numbers, whatever the size of the corpus.
A bin's probability is the language's own share mixed with the mean share of all
languages, so that what a language never showed speaks against it by a fixed amount
and what nobody showed says nothing.

*Prediction.* The script of a word (from ranges of code points) narrows the candidates
to the languages written in it; words in a script of no language leave all of them. A word's
score per candidate is the sum of its log-probabilities. Viterbi then gives the
labelling of a text's words with the greatest total score less ``SWITCH`` for every
change of language, exactly: texts are cut into stretches of ``STRETCH`` words that
advance together word by word, the later ones of a text from every possible language
before them; the stretches of a text are then chained, and a second walk along the
chosen ends labels the words. So the number of numpy steps does not grow with a text.

The language of a text is the one that labels most of its letters (ties: the first by
name); the score is the mean over its letters of the language's posterior in
their words. Spans give first word, number of words and language.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and
no spans; so is every text where nothing was learned (no training row with a
language and a letter); rows with a null language or a null id are not learned from;
a null id is not held out; each of repeated rows counts and is judged by itself; a run of over
``PIECE`` letters counts as several words; very long texts are read in pieces of
``PIECE`` characters, so memory is some 50 bytes a word beside the text; equal scores go to the first language by name and
to no change; an empty table gives an empty result; at most ``MAX_LANGUAGES`` languages are
learned, those with most letters; the columns id, text and (training only) language are the only ones read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import by_bytes

BINS = 1 << 15
SWITCH = 12.0  # nats a change of language costs
OWN = 0.95  # weight of a language's own share of a bin
FLOOR = 1e-3 / BINS
LEAST_SHARE = 1e-3  # of a language's letters, for a script to count as its own
MAX_LANGUAGES = 256
FOLDS, HELD_OUT = 4, 2
BATCH_BYTES = 2 << 20
PIECE = 1 << 20  # characters read at a time
STRETCH = 512  # words
UNKNOWN = "und"

# Scripts and their ranges of code points, first to last.
SCRIPTS = """
Latin 0041 024F
Latin 1E00 1EFF
Greek 0370 03FF
Cyrillic 0400 052F
Armenian 0530 058F
Hebrew 0590 05FF
Arabic 0600 077F
Devanagari 0900 097F
Bengali 0980 09FF
Tamil 0B80 0BFF
Thai 0E00 0E7F
Georgian 10A0 10FF
Hangul 1100 11FF
Hangul AC00 D7AF
Kana 3040 30FF
Han 3400 9FFF
Han 20000 323AF
"""
NAMES = ["other", *dict.fromkeys(x.split()[0] for x in SCRIPTS.split("\n") if x)]


@cache
def _classes() -> np.ndarray:
    """Per code point 0 (no letter), or 1 + the number of its script; marks count as letters once one stands before them."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x323B0):
        if unicodedata.category(chr(c))[0] in "LM":
            out[c] = 1
    for name, first, last in (x.split() for x in SCRIPTS.split("\n") if x):
        part = out[int(first, 16):int(last, 16) + 1]
        part[part > 0] = 1 + NAMES.index(name)
    return out


def letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin per letter, place of each word's first letter among the letters, its place in the lower-cased text)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = _classes()[points] > 0
    at = np.flatnonzero(own)
    if not len(at):
        return np.zeros(0, np.int64), at, at
    begins = np.empty(len(at), bool)
    begins[0] = True
    np.not_equal(np.diff(at), 1, out=begins[1:])
    mixed = points[at] * np.uint32(0x9E3779B1)
    before, after = np.empty_like(mixed), np.empty_like(mixed)
    before[1:], after[:-1] = mixed[:-1], mixed[1:]
    before[begins] = 0
    after[:-1][begins[1:]] = 0
    after[-1] = 0
    h = (before ^ (before >> np.uint32(15))) * np.uint32(0x85EBCA6B) + mixed
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) + after
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x27D4EB2F)
    first = np.flatnonzero(begins)
    return (h >> np.uint32(17)).astype(np.int64), first, at[first]


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most PIECE characters, cut before the last character that is no letter where there is one."""
    lo = 0
    while len(text) - lo > PIECE:
        hi = lo + PIECE
        for end in range(hi, lo, -4096):  # look back in small steps
            part = text[max(lo, end - 4096):end]
            k = next((i for i in range(len(part) - 1, 0, -1) if not part[i].isalpha() and not unicodedata.category(part[i]).startswith("M")), 0)
            if k:
                hi = end - len(part) + k
                break
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _groups(texts: list[str | None]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Lower-cased texts joined by line ends, some PIECE characters at a time: (joined, number of each text, where it begins)."""
    parts, numbers, begins, size = [], [], [], 0
    for i, t in enumerate(texts):
        for piece in _pieces((t or "").lower()):
            if parts and size + len(piece) > PIECE:
                yield "\n".join(parts), numbers, begins
                parts, numbers, begins, size = [], [], [], 0
            parts.append(piece)
            numbers.append(i)
            begins.append(size)
            size += len(piece) + 1
    if parts:
        yield "\n".join(parts), numbers, begins


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_share: np.ndarray  # (BINS, languages)
    written: np.ndarray  # (scripts, languages): whether the language is written in the script

    def words(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text (score of every word and language, letters of every word); no candidate has -inf."""
        k = len(self.languages)
        out: list[list] = [[] for _ in texts]
        for joined, numbers, begins in _groups(texts):
            bins, first, at = letters(joined)
            if not len(first):
                continue
            score = np.add.reduceat(self.log_share[bins], first, axis=0)
            size = np.diff(np.append(first, len(bins)))
            script = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)[at]] - 1
            allowed = self.written[script]
            score[~allowed & allowed.any(1)[:, None]] = -np.inf
            edges = np.append(np.searchsorted(at, begins), len(at))
            for i, lo, hi in zip(numbers, edges.tolist(), edges[1:].tolist()):
                out[i].append((score[lo:hi], size[lo:hi]))
        none = (np.zeros((0, k)), np.zeros(0, np.int64))
        return [(np.concatenate([s for s, _ in x]), np.concatenate([n for _, n in x])) if x else none for x in out]

    def label(self, texts: list[str | None], switch: float = SWITCH) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) per text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        words = self.words(texts)
        out = []
        for (score, size), labels in zip(words, viterbi([s for s, _ in words], switch)):
            if not len(size):
                out.append((UNKNOWN, 0.0, []))
                continue
            weight = np.bincount(labels, size, len(self.languages))
            best = int(weight.argmax())
            share = np.exp(score - score.max(1, keepdims=True))
            posterior = float((share[:, best] / share.sum(1)) @ size / size.sum())
            cuts = np.flatnonzero(np.diff(labels, prepend=-1)).tolist()
            spans = [(a, b - a, self.languages[labels[a]]) for a, b in zip(cuts, cuts[1:] + [len(labels)])]
            out.append((self.languages[best], min(1.0, max(0.0, posterior)), spans))
        return out


class Lanes:
    """Stretches of words side by side, the longest first: step t holds word t of every stretch that has one."""

    def __init__(self, scores: np.ndarray, sizes: np.ndarray):
        self.count, k = len(sizes), scores.shape[1]
        self.order = np.argsort(-sizes, kind="stable")
        rank = np.empty(self.count, np.int64)
        rank[self.order] = np.arange(self.count)
        steps = np.arange(sizes.max(initial=0))
        self.active = self.count - np.searchsorted(np.sort(sizes), steps, "right")
        self.begin = np.cumsum(self.active) - self.active
        step = np.arange(len(scores)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.begin[step] + np.repeat(rank, sizes)  # of every word
        self.score = np.empty((k, len(scores)))
        self.score[:, self.place] = scores.T

    def walk(self, enter: np.ndarray, switch: float, back: np.ndarray | None = None) -> np.ndarray:
        """Best total per language and stretch at its end, from ``enter`` (languages, variants, stretches)."""
        value = np.ascontiguousarray(enter[..., self.order])
        own = np.arange(len(value))[:, None]
        for a, n in zip(self.begin.tolist(), self.active.tolist()):
            now = value[..., :n]
            jump = now.max(0) - switch
            if back is not None:  # of one variant
                back[:, a:a + n] = np.where(now[:, 0] >= jump, own, now[:, 0].argmax(0))
            np.maximum(now, jump, out=now)
            now += self.score[:, None, a:a + n]
        out = np.empty_like(value)
        out[..., self.order] = value
        return out

    def before(self, back: np.ndarray) -> np.ndarray:
        """Language before each stretch per language at its end."""
        k = len(back)
        at = np.repeat(np.arange(k)[:, None], self.count, 1)
        for a, n in zip(self.begin[::-1].tolist(), self.active[::-1].tolist()):
            at[:, :n] = np.take_along_axis(back[:, a:a + n], at[:, :n], 0)
        out = np.empty_like(at)
        out[:, self.order] = at
        return out

    def follow(self, back: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Language of every word of the ways that end in ``end``."""
        at = end[self.order]
        labels = np.empty(back.shape[1], np.int64)
        for a, n in zip(self.begin[::-1].tolist(), self.active[::-1].tolist()):
            labels[a:a + n] = at[:n]
            at[:n] = back[at[:n], np.arange(a, a + n)]
        return labels[self.place]


def viterbi(scores: list[np.ndarray], switch: float = SWITCH, stretch: int = STRETCH) -> list[np.ndarray]:
    """Per text the language of every word: the greatest sum of scores less ``switch`` per change.

    Impossible words (-inf) must leave one language."""
    sizes = np.array([len(s) for s in scores], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in scores]
    every = np.maximum(np.concatenate(scores), -1e30)
    k = every.shape[1]
    parts = -(-sizes // stretch)
    owner = np.repeat(np.arange(len(sizes)), parts)
    first = np.diff(owner, prepend=-1) != 0
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(stretch, sizes[owner] - number * stretch)
    lanes = Lanes(every, size)
    enter = np.zeros((k, len(owner)))  # best total per language before a stretch
    later = np.flatnonzero(~first)
    if len(later):  # what a stretch makes of every language before it, then the stretches of a text in a row
        more = Lanes(every[np.repeat(~first, size)], size[later])
        only = np.where(np.eye(k, dtype=bool), 0.0, -1e300)[:, :, None]
        through = more.walk(np.repeat(only, len(later), 2), switch)  # after, before, stretch
        followed = np.flatnonzero(~first[1:] & first[:-1])  # first stretches with another one after them
        alone = Lanes(every[np.repeat(np.isin(np.arange(len(owner)), followed), size)], size[followed])
        start = dict(zip(followed.tolist(), alone.walk(np.zeros((k, 1, len(followed))), switch)[:, 0].T))
        value = None
        for j, c in enumerate(later.tolist()):
            value = start[c - 1] if first[c - 1] else value
            enter[:, c] = value - value.max()
            value = (enter[:, c] + through[:, :, j]).max(1)
    back = np.empty((k, len(every)), np.int16)
    end = lanes.walk(enter[:, None], switch, back)[:, 0].argmax(0)
    if len(later):  # ends of the earlier stretches follow from the ones after them
        before = lanes.before(back)
        for c in later[::-1].tolist():
            end[c - 1] = before[end[c], c]
    labels = lanes.follow(back, end)
    return np.split(labels, np.cumsum(sizes)[:-1])


def fold(id_col: Column) -> Column:
    """The remainder that puts a row in or out of the training; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          max_languages: int = MAX_LANGUAGES) -> Model:
    """The model of all rows outside the held-out fold."""
    wide = BINS + len(NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                                 names=["lang", "bin", "n"])
            total.clear()

        for b in by_bytes(batches, 0, BATCH_BYTES):
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(t)
            for lang, texts in by_lang.items():
                n = total.setdefault(lang, np.zeros(wide, np.int64))
                for joined, _, _ in _groups(texts):
                    n[:BINS] += np.bincount(letters(joined)[0], minlength=BINS)
                    script = np.bincount(_classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)],
                                         minlength=len(NAMES) + 1)
                    n[BINS:] += script[1:]
            if len(total) > MAX_LANGUAGES:
                yield from rows()
        yield from rows()

    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col)) != HELD_OUT)).select(
        F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = (rows.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    found = per_lang.orderBy(F.desc("size"), "lang").limit(max_languages).collect()
    found = sorted((r for r in found if r["size"]), key=lambda r: r["lang"])
    n = np.zeros((len(found), wide))
    for i, r in enumerate(found):
        n[i, list(r["bins"])] = list(r["bins"].values())
    n = n[n[:, :BINS].any(1)]
    langs = [r["lang"] for r in found]
    if not langs:
        return Model([], np.zeros((BINS, 0)), np.zeros((len(NAMES), 0), bool))
    share = n[:, :BINS] / n[:, :BINS].sum(1, keepdims=True)
    log_share = np.log(OWN * share + (1 - OWN) * share.mean(0) + FLOOR).T
    written = (n[:, BINS:] >= LEAST_SHARE * n[:, BINS:].sum(1, keepdims=True)).T & (n[:, BINS:].T > 0)
    return Model(langs, np.ascontiguousarray(log_share), written)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """``id, held_out, lang_pred, score, spans`` per row."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0, BATCH_BYTES):
            lang, score, spans = zip(*model.label(b.column(0).to_pylist(), switch))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array([[dict(zip(("word", "words", "lang"), s)) for s in x] for x in spans], pa.list_(span))],
                names=[id_col, "held_out", "lang_pred", "score", "spans"])

    src = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).alias(id_col),
                      F.coalesce(fold(F.col(id_col)) == HELD_OUT, F.lit(False)).alias("_held"))
    return src.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, "
                               "spans array<struct<word:bigint,words:bigint,lang:string>>")

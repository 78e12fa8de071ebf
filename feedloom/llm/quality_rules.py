"""Line-first cleaning and document quality rules, as DataFrame expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed; a document that loses too much of its text is rejected. The
base rules (too few words, too much text in repeated 8-word windows) are judged
on the whole text. All rules are per row: no shuffle, no join, no Python.

Defined results: a null or empty text has no words and fails the base rule; its
cleaned text is null or empty; repeated rows are judged alike; an empty table
gives an empty result. ``with_quality`` keeps all input columns and puts its
results into one struct column, whose name is a parameter, so columns of the
input cannot clash; ``quality_report`` reads the id and the text only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_LOST_PERCENT = 50  # of the characters in words
NAV_SEPARATORS = 3  # stand-alone separators that make a line a menu or a table row

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

# Boilerplate phrases of web pages (lower case).
BOILERPLATE = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "we use cookies", "enable javascript", "lorem ipsum", "click here", "sign up for our newsletter",
               "back to top", "skip to content"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once (a variable bound by a one-element array)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words as an array; null text gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the array, first occurrences included."""
    n = F.size(words)

    def covered(starts: Column) -> Column:
        """Size of the union of the windows at the sorted ``starts``."""
        later = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
        steps = F.zip_with(starts, later, lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

    def over(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeats = lambda s: F.filter(F.zip_with(
            F.zip_with(s, F.concat(F.array(F.lit(None).cast("bigint")), F.transform(s, lambda x: x["h"])),
                       lambda x, before: F.struct(x["h"].alias("h"), x["i"].alias("i"), before.alias("b"))),
            F.slice(F.transform(s, lambda x: x["h"]), F.lit(2), F.greatest(F.size(s) - 1, F.lit(1))),
            lambda x, after: F.when((x["h"] == x["b"]) | (x["h"] == after), x["i"])), lambda i: i.isNotNull())
        twice = let(at, repeats)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(twice), covered))

    def doubled(hashes: Column, by: int) -> Column:
        """Hashes of twice as many words: each with the one ``by`` places on."""
        return let(hashes, lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - by), F.slice(h, F.lit(1 + by), F.size(h) - by),
                                                lambda a, b: F.xxhash64(a, b)))

    def windows(w: Column) -> Column:
        return doubled(doubled(doubled(F.transform(w, lambda x: F.xxhash64(x)), 1), 2), 4)

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(windows(words), over))


SHOUT, NOISE = r"[!?]{2,}", rf"[{SYMBOLS}]{{2,}}"
MENU = rf"(?:^|{SPACE})[|>»·•](?={SPACE}|$)"
STUTTER = rf"(?:^|{SPACE})([^\x20\x09-\x0D]+)(?={SPACE}+\1(?:{SPACE}|$))"
STUTTERED = rf"(?:^|{SPACE})([^\x20\x09-\x0D]+)(?:{SPACE}+\1){{3}}(?:{SPACE}|$)"  # four in a row
SUSPECT = "[!?#*$%&|<>»·•]"
PLATE_CHARS = 80  # boilerplate stands in short lines


def boilerplate(line: Column) -> Column:
    return let(F.lower(line), lambda x: F.forall(F.array([F.lit(p) for p in BOILERPLATE]), lambda p: ~x.contains(p))) == F.lit(False)


def line_fails(line: Column) -> Column:
    """Whether a line is no running text: shouting, symbol noise, stuttered words, a menu or table row, boilerplate."""
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    most = lambda pattern: 2 * F.regexp_count(line, F.lit(pattern)) > n
    punctuation = (line.rlike(SHOUT) & most(SHOUT)) | (line.rlike(NOISE) & most(NOISE)) | (line.rlike(STUTTERED) & most(STUTTER))
    navigation = line.rlike(MENU) & (F.regexp_count(line, F.lit(MENU)) >= NAV_SEPARATORS)
    return punctuation | navigation | ((F.char_length(line) <= PLATE_CHARS) & boilerplate(line))


def clean_lines(text: Column) -> Column:
    """The text without its failing lines. Texts in which no rule can fire skip the line work."""
    suspect = text.rlike(SUSPECT) | text.rlike(STUTTERED) | boilerplate(text)
    return F.when(suspect, F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x)), "\n")).otherwise(text)


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.coalesce(F.char_length(text) - F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Struct of all counts, the verdict and the cleaned text."""
    t = F.coalesce(text, F.lit(""))

    def lines(ls: Column) -> Column:
        return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")

    def judged(w: Column) -> Column:
        return let(F.struct(
            F.size(w).cast("long").alias("n_words"), word_chars(t).alias("word_chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"), clean_lines(text).alias("cleaned")), verdict)

    def verdict(s: Column) -> Column:
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
        lost = 100 * (s["word_chars"] - word_chars(s["cleaned"])) > MAX_LOST_PERCENT * s["word_chars"]
        return F.struct(*[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                        failed.alias("base_failed"), (~failed & ~lost).alias("kept"), s["cleaned"].alias("cleaned"))

    return let(words_of(text), judged)


def with_quality(docs: DataFrame, text_col: str = "text", into: str = "quality") -> DataFrame:
    """All input columns and the struct column ``into`` (replaced if the input has one of that name)."""
    return docs.withColumn(into, quality(F.col(text_col).cast("string")))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` per row."""
    q = docs.select(F.col(id_col), quality(F.col(text_col).cast("string")).alias("_q"))
    return q.select(id_col, *[F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                         "n_repeat_words", "base_failed", "kept")])

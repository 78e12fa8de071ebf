"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

A block (a line, or as many words in a row as the template has, over line breaks) matches a
template if it holds at least ``THRESHOLD`` of the template's distinct tokens, and all of those that name a license. For lines, tokens are put in one global order, rarest in the
corpus first. If a block holds ``need`` tokens of a template, then the two
share a token among the template's first ``size - need + 1`` (its prefix), so
only these are joined; block length and the places of the shared token in
both lists rule out further pairs before the overlap is counted. Everything is
DataFrame expressions; templates are a parameter of a few hundred tokens, the only
thing that is broadcast.

Defined results: a null or empty text has no words, no labels and score 0;
rows that repeat id and text get the same result each; null ids are kept; an
empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The phrases that are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Opening sentences of public licenses and usual notices: label -> texts.
TEMPLATES = {
    "apache-notice": ["licensed under the apache license version 2 0 you may not use this file except in compliance with the license"],
    "bsd-notice": ["redistribution and use in source and binary forms with or without modification are permitted "
                   "provided that the following conditions are met"],
    "cc-by-nc-notice": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-notice": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "gpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general "
                   "public license as published by the free software foundation",
                   "this work is licensed under the gnu general public license version 3"],
    "mit-notice": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                   "documentation files to deal in the software without restriction",
                   "released under the mit license"],
    "rights-reserved": ["all rights reserved"],
}
# The words that tell licenses apart; a block must hold all those of the template it matches.
NAMES = {"apache", "attribution", "bsd", "by", "cc", "commons", "creative", "gnu", "mit", "nc", "noncommercial"}
THRESHOLD = 0.8

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words of a lower-cased text
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"  # the same words before lower-casing
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), lambda w: w != "")


def phrase_starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    p = phrase.split(" ")
    same = lambda i: F.try_element_at(words, i + 1).eqNullSafe(F.lit(p[0]))

    def here(i: Column) -> Column:
        ok = same(i)
        for k in range(1, len(p)):
            ok = ok & F.try_element_at(words, i + 1 + k).eqNullSafe(F.lit(p[k]))
        return ok

    return F.filter(F.sequence(F.lit(0), F.size(words)), here)


def phrase_report(text: Column) -> Column:
    """Struct of n_base, first_word, last_word and base_labels. Texts without a word all phrases need skip the word work."""
    last_words = sorted({p.split(" ")[-1] for p in PHRASES})
    maybe = text.rlike(f"(?i)(?<!{WORD[:-1]})(?:{'|'.join(last_words)})(?!{WORD[:-1]})")

    def report(words: Column) -> Column:
        found = F.struct(*[phrase_starts(words, p).alias(f"p{k}") for k, p in enumerate(PHRASES)])

        def summed(f: Column) -> Column:
            every = [f[f"p{k}"] for k in range(len(PHRASES))]
            names = F.array(*[F.when(F.size(e) > 0, F.lit(label)) for e, label in zip(every, PHRASES.values())])
            return F.struct(sum((F.size(e) for e in every), F.lit(0)).cast("long").alias("n_base"),
                            F.array_min(F.concat(*every)).cast("long").alias("first_word"),
                            F.array_max(F.concat(*every)).cast("long").alias("last_word"),
                            F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("base_labels"))

        return let(found, summed)

    none = F.struct(F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"),
                    F.lit(None).cast("long").alias("last_word"), F.array().cast("array<string>").alias("base_labels"))
    return F.when(maybe, let(words_of(text), report)).otherwise(none)


def token_order(docs: DataFrame, vocabulary: list[str], text_col: str) -> list[str]:
    """The template tokens by the number of documents that hold them, rarest first (counted over all documents)."""
    held = F.explode(F.array_intersect(words_of(F.col(text_col)), F.array(*[F.lit(t) for t in vocabulary])))
    counts = dict(docs.select(held.alias("t")).groupBy("t").count().collect())  # a row per template token at most
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def matches(docs: DataFrame, key: list[str], text_col: str, templates: dict[str, list[str]] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """``key, block, label, template, containment``: every block of ``docs`` that reaches the threshold of a template."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(t.split(" ")))) for label, ts in templates.items() for t in ts]
    order = token_order(docs, sorted({t for _, s in sets for t in s}), text_col)
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for n, (label, tokens) in enumerate(sets):
        ranks = sorted(rank[t] for t in tokens)
        need = math.ceil(threshold * len(ranks) - 1e-9)
        named = sorted(rank[t] for t in tokens if t in NAMES)
        rows += [(r, place, n, label, ranks, need, named) for place, r in enumerate(ranks[:len(ranks) - need + 1])]
    prefixes = spark.createDataFrame(rows, "token int, place int, template int, label string, t_ranks array<int>, need int, named array<int>")
    seeds = F.array(*[F.lit(order[r]) for r in sorted({r[0] for r in rows})])
    ranked = F.map_from_arrays(F.array(*[F.lit(t) for t in order]), F.array(*[F.lit(i) for i in range(len(order))]))
    blocks = (docs.filter(F.arrays_overlap(words_of(F.col(text_col)), seeds))
              .select(*key, F.posexplode(F.split(text_col, "\n", -1)).alias("block", "_line"))
              .select(*key, "block", F.array_intersect(words_of(F.col("_line")), F.array(*[F.lit(t) for t in order])).alias("_own"))
              .filter(F.arrays_overlap("_own", seeds))
              .select(*key, "block", F.array_sort(F.transform("_own", lambda t: F.element_at(ranked, t))).alias("_ranks")))
    tokens = blocks.select("*", F.posexplode("_ranks").alias("_place", "_token"))
    pairs = tokens.join(F.broadcast(prefixes), F.col("_token") == F.col("token"))
    left = F.least(F.size("t_ranks") - F.col("place"), F.size("_ranks") - F.col("_place"))
    pairs = pairs.filter((F.size("_ranks") >= F.col("need")) & (left >= F.col("need")))  # length and position
    # the first shared token of a pair decides, so each pair is counted once
    first = F.array_min(F.array_intersect("_ranks", "t_ranks")) == F.col("token")
    shared = F.size(F.array_intersect("_ranks", "t_ranks"))
    return (pairs.filter(first & (shared >= F.col("need")) & (F.size(F.array_except("named", "_ranks")) == 0))
            .select(*key, "block", "label", "template", (shared / F.size("t_ranks")).alias("containment")))


def wrapped(docs: DataFrame, key: list[str], text_col: str, templates: dict[str, list[str]] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """``key, label, containment``: the best run of words, as long as the template and over line breaks, that reaches the threshold."""
    sets = [(label, sorted(set(t.split(" "))), len(t.split(" "))) for label, ts in templates.items() for t in ts]
    words = lambda ts: F.array(*[F.lit(t) for t in ts])
    every = F.array(*[F.struct(F.lit(label).alias("label"), words(ts).alias("tokens"), F.lit(math.ceil(threshold * len(ts) - 1e-9)).alias("need"),
                               F.lit(n).alias("length"), words([t for t in ts if t in NAMES]).cast("array<string>").alias("named"))
                      for label, ts, n in sets])
    own = F.array_intersect(words_of(F.col(text_col)), words(sorted({t for _, ts, _ in sets for t in ts})))
    maybe = let(own, lambda o: F.filter(every, lambda t: (F.size(F.array_intersect(o, t["tokens"])) >= t["need"])
                                        & (F.size(F.array_except(t["named"], o)) == 0)))
    pairs = (docs.select(*key, text_col, maybe.alias("_maybe")).filter(F.size("_maybe") > 0)
             .select(*key, text_col, F.explode("_maybe").alias("_t")))
    places = F.filter(F.transform(words_of(F.col(text_col)), lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
                      lambda x: F.array_contains(F.col("_t.tokens"), x["w"]))

    def worth(run: Column) -> Column:
        return F.when(F.size(F.array_except("_t.named", run)) == 0, F.size(F.array_distinct(run))).otherwise(0)

    def held(p: Column) -> Column:
        """The most distinct tokens in a run that begins with a token of the template and holds all its names."""
        return F.array_max(F.transform(p, lambda x, k: worth(F.transform(
            F.filter(F.slice(p, k + 1, F.col("_t.length")), lambda y: y["i"] < x["i"] + F.col("_t.length")), lambda y: y["w"]))))

    found = pairs.select(*key, "_t", let(places, held).alias("_held")).filter(F.col("_held") >= F.col("_t.need"))
    return found.select(*key, F.col("_t.label").alias("label"), (F.col("_held") / F.size("_t.tokens")).alias("containment"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row."""
    text = F.col("_text")
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    columns = ["_id", "_hash", "label", "containment"]
    blocks = matches(src, ["_id", "_hash"], "_text").select(*columns).unionAll(wrapped(src, ["_id", "_hash"], "_text").select(*columns))
    found = (blocks.groupBy("_id", "_hash")
             .agg(F.collect_set("label").alias("_own"), F.max("containment").alias("_best")))  # a label each at most
    base = src.select("_id", "_hash", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
                      phrase_report(text).alias("_b"))
    both = base.alias("b").join(found.alias("f"), F.col("b._id").eqNullSafe(F.col("f._id")) & (F.col("b._hash") == F.col("f._hash")), "left")
    labels = F.array_sort(F.array_union("_b.base_labels", F.coalesce("_own", F.array().cast("array<string>"))))
    return both.select(
        F.col("b._id").alias(id_col), "n_words", "_b.n_base", "_b.first_word", "_b.last_word",
        F.array_join("_b.base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("_b.n_base") > 0, 1.0).otherwise(0.0), F.coalesce("_best", F.lit(0.0))).alias("score"))

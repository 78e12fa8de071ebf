import random

import pytest
from pyspark.sql import types as T

EXTRA = ["n_bytes", "n_tokens", "key", "id", "bands", "chunk", "bucket", "quality", "score", "x", "hash", "value", "labels", "start",
         "segment", "digest", "payload", "owner", "_text", "_id", "_hash", "doc", "text_crc32", "kept", "items", "_crc", "count", "rep", "node", "root", "a", "b", "f", "p", "pivot", "z", "_i", "_t"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                      + [T.StructField(c, T.StringType()) for c in EXTRA])


def words(rnd, n, size=400):
    return [rnd.choice(["ba", "Ké", "di", "mo", "ru", "的", "sé", "to"]) + rnd.choice(["n", "l", "rr", "s"]) + str(rnd.randrange(size)) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Odd cases, copies, near copies, shared passages and benchmark leaks: (doc_id, text)."""
    rnd = random.Random(7)
    passage = " ".join(words(rnd, 70))
    line = " ".join(words(rnd, 14)) + "."
    long = " ".join(words(rnd, 9000)) + "\n" + passage
    near = words(rnd, 120)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one Two"), (5, "ONE two"), (6, "a\x00b\x1c\x85 　c 😀 ﬁ"), (None, passage),
           (None, "no id here"), (7, long), (8, line + "\n" + line), (8, line + "\n" + line), (9, "x" * 300), (10, "x" * 300 + "y"),
           (11, "Licensed under the Apache License, Version 2.0.\nMIT license CC by cc BY-NC 4.0"), (12, "ALL RIGHTS RESERVED\nGNU  General-Public\nlicense"),
           (13, " ".join(["same words here"] * 30)), (14, "A!! B!! C!! D!! " * 8), (15, "<|endoftext|> <s> </s> <unk> it's We'LL 12.5"),
           (16, "\n\n" + passage + "\r\n" + passage)]
    for i in range(20, 60):
        t = words(rnd, rnd.randrange(5, 200))
        if i % 3 == 0:
            k = rnd.randrange(len(t))
            t[k:k] = passage.split(" ")
        if i % 4 == 0:
            t = list(near)
            for _ in range(rnd.randrange(0, 9)):
                t[rnd.randrange(len(t))] = "new" + str(rnd.randrange(10 ** 6))
        if i % 5 == 0:
            t = t + ["\n" + line]
        out.append((i, " ".join(t)))
    out += [(70 + k, out[30 + k][1]) for k in range(5)]  # exact copies
    return out


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """A stored table of (doc_id, text) rows with the columns of ``documents`` and many clashing ones."""
    def store(rows, name="docs"):
        path = str(tmp_path_factory.mktemp(name)) + "/t"
        full = [(i, t, "en", "s", len(t) if t is not None else None) + ("clash",) * len(EXTRA) for i, t in rows]
        spark.createDataFrame(full, SCHEMA).repartition(3, "doc_id").write.parquet(path)
        return spark.read.parquet(path)
    return store


@pytest.fixture(scope="session")
def docs(make, rows):
    return make(rows)


@pytest.fixture(scope="session")
def empty(make):
    return make([], "empty")

"""Near duplicates inside one family of texts: every link is found, few pairs are looked at."""

import random

import pytest

from test_llm_operators import brute_near, got


def variants(n, edits, words=200, seed=3):
    """Texts of one origin with ``edits`` words changed, each by itself or (a third) on a shared spot."""
    rnd = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for j in range(rnd.choice(edits)):
            k = rnd.randrange(words)
            t[k] = f"s{k}" if j % 3 == 0 else f"z{i}x{j}"
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("edits,percent,size", [([2, 4, 5, 6, 8], 85, 3), ([1, 3, 4, 5, 7], 80, 5), ([6, 7, 8, 9, 10, 11, 12], 85, 3)])
def test_links_of_a_family(make, tmp_path, edits, percent, size):
    from feedloom.llm.near_duplicates import near_duplicates

    rows = variants(150, edits)
    found = near_duplicates(make(rows, "family"), str(tmp_path / "n"), percent, size)
    assert got(found, "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, percent, size)


def test_sharing_keeps_every_link(spark, make, tmp_path):
    """The filters of ``sharing`` against all pairs of a family, nothing being connected yet."""
    from pyspark.sql import functions as F

    from feedloom.llm import near_duplicates as nd

    percent, size = 85, 3
    rows = variants(120, [3, 5, 6, 7, 9], seed=5)
    docs = make(rows, "sharing")
    sets = nd.sets_of(docs, size, "text").distinct().cache()
    held = {bytes(r.key): set(memoryview(r.shingles).cast("Q")) for r in sets.collect()}
    family = sets.select(F.lit(b"f").alias("f"), "key", (F.length("shingles") / 8).cast("long").alias("n"), F.col("key").alias("root"))
    diffs = nd.differences(family, sets, percent)
    best = diffs.groupBy("f").agg(F.max(F.struct("slack", "key")).alias("best"))
    slack = {bytes(r.key): r.slack for r in diffs.collect()}
    top = max(slack.items(), key=lambda kv: (kv[1], kv[0]))
    sure = {k for k, s in slack.items() if s + top[1] >= 0}
    roots = [(k, top[0] if k in sure else k) for k in held]
    pairs = nd.sharing(diffs, best, spark.createDataFrame(roots, "node binary, root binary"), percent)
    seen = {(bytes(r.a), bytes(r.b)) for r in pairs.collect()}
    of, links = dict(roots), set()
    for a in held:
        for b in held:
            both = len(held[a] & held[b])
            if a < b and of[a] != of[b] and 100 * both >= percent * (len(held[a]) + len(held[b]) - both):
                links.add((a, b))
    assert links <= seen
    assert links and len(seen) <= 3 * len(links) + len(held)


def test_candidates_of_unlinked_variants_grow_slowly(make, tmp_path, monkeypatch):
    """Variants too far from each other to be linked: the pairs looked at don't grow with their square."""
    from feedloom.llm import near_duplicates as nd

    plain, made = nd.sharing, {}
    for n in (100, 400):
        def counted(*args, n=n):
            pairs = plain(*args)
            made[n] = pairs.count()
            return pairs

        monkeypatch.setattr(nd, "sharing", counted)
        rows = variants(n, [9, 10, 11], seed=9)
        found = nd.near_duplicates(make(rows, "far"), str(tmp_path / str(n)), 85, 3)
        assert got(found, "doc_id", "n_shingles", "component_id", "kept") == brute_near(rows, 85, 3)
    print(made)
    assert made.get(400, 0) <= 8 * max(made.get(100, 0), 25)

"""Periodic runs, language spans and centroid clustering against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import centroids as C, languages as L, periodic_runs as P
from feedloom.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- periodic runs

def brute_runs(x, shortest=24, times=3):
    out = []
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(shortest, times * q):
                w = x[i:i + n]
                if not any(w[r:] == w[:-r] for r in range(1, q)):
                    out.append((i, n, q))
            i = j + 1
    return sorted(out)


def odd_words(rnd):
    x = []
    while len(x) < rnd.choice([5, 30, 60, 140]):
        if rnd.random() < .5:
            x += [rnd.randrange(rnd.choice([2, 3, 50])) for _ in range(rnd.randrange(1, 9))]
        else:
            b = [rnd.randrange(rnd.choice([1, 2, 4, 60])) for _ in range(rnd.randrange(1, 12))]
            x += (b * rnd.randrange(2, 9))[rnd.randrange(len(b)):]
    return x


@pytest.mark.parametrize("shortest", [3, 6, 12, 24])
def test_runs_are_all_maximal_repeats(shortest):
    rnd = random.Random(shortest)
    some = 0
    for _ in range(400):
        x = odd_words(rnd)
        want = brute_runs(x, shortest)
        assert P.runs_of(np.array(x), shortest) == want
        ids = np.array(x)
        assert sorted((lo + s, n, q) for lo, hi in P.segments(ids, shortest) for s, n, q in P.lag_scan(ids[lo:hi], shortest, pairs=5)) == want
        some += bool(want)
    assert some > 50


def test_segments_are_stable_and_hold_every_run():
    rnd = random.Random(3)
    for _ in range(300):
        x = odd_words(rnd)
        parts = P.segments(np.array(x), 6)
        for lo, hi in parts:
            assert hi - lo >= 6 and min(Counter(x[lo:hi]).values()) >= 3
        for s, n, _ in brute_runs(x, 6):
            assert any(lo <= s and s + n <= hi for lo, hi in parts)


def test_deep_cuts_and_long_texts_stay_fast():
    # every word three times: the first cut falls at the end, and each one makes the next
    n = 20_000
    chain = np.array([k // 2 for k in range(2 * n)] + [n] + list(range(n)))
    begin = time.time()
    P.segments(chain)
    rng = np.random.default_rng(1)
    assert P.runs_of(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    block = rng.permutation(100_000)
    assert P.runs_of(np.tile(block, 4)) == [(0, 400_000, 100_000)]
    P.runs_of(rng.integers(0, 2, 200_000))
    assert time.time() - begin < 60


def brute_row(i, t, rewrite):
    w = WORD.findall(t or "")
    if rewrite and w and (source := P.echo_plan(i, len(w))) is not None:
        w = [w[k] for k in source.tolist()]
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return i, len(w), tuple(runs), best, " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("rewrite", [None, P.echo_plan])
def test_periodic_runs_of_odd_rows(make, rows, rewrite):
    own = [(i, t) for i, t in rows if not t or len(t) < 5000]
    own += [(200, "a b c " * 9 + "x " + "a b c " * 9), (201, "q\x0bw\x0ce\tr\n" * 6), (202, "z " * 23), (203, "z " * 24), (204, "k l " * 30 + "m n o " * 10),
            (200, "a b c " * 9 + "x " + "a b c " * 9)] + [(300 + k, " ".join(f"w{j}" for j in range(90))) for k in range(40)]
    found = P.periodic_runs(make(own, "runs"), rewrite=rewrite)
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.strongest and tuple(r.strongest), r.collapsed) for r in found.collect())
    assert got == Counter(brute_row(i, t, rewrite) for i, t in own)
    assert sum(bool(r[2]) for r in got) >= 4


def test_echo_plan_follows_the_id():
    seen = 0
    for i in range(400):
        h, n = zlib.crc32(str(i).encode()), 50
        source = P.echo_plan(i, n)
        if h % 10:
            assert source is None
            continue
        seen += 1
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        assert source.tolist() == [k if k < a else a + (k - a) % p for k in range(n)]
    assert seen > 20 and P.echo_plan(None, 5) is None


def test_a_very_long_text_of_runs(make):
    block = " ".join(f"w{k}" for k in range(40_000))
    row = P.periodic_runs(make([(1, " ".join([block] * 30))], "long")).collect()[0]  # 8 MB
    assert [tuple(r) for r in row.runs] == [(0, 1_200_000, 40_000)] and row.collapsed == block


# ---- languages

def worth(scores, labels, switch):
    return sum(scores[i, k] for i, k in enumerate(labels)) - switch * sum(a != b for a, b in zip(labels, labels[1:]))


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(150):
        k = int(rng.integers(1, 4))
        scores = [rng.normal(size=(int(rng.integers(0, 8)), k)) * 3 for _ in range(6)]
        switch, stretch = float(rng.choice([0.5, 2.0, 5.0])), int(rng.choice([1, 2, 3, 512]))
        for s, labels in zip(scores, L.viterbi(scores, switch, stretch)):
            assert len(labels) == len(s)
            if len(s):
                best = max(worth(s, x, switch) for x in itertools.product(range(k), repeat=len(s)))
                assert abs(worth(s, labels.tolist(), switch) - best) < 1e-9


def test_viterbi_leaves_out_impossible_languages():
    s = np.array([[0.0, -np.inf], [1.0, 5.0], [0.0, -np.inf]])
    assert L.viterbi([s], 1.0)[0].tolist() == [0, 1, 0] and L.viterbi([s], 3.0)[0].tolist() == [0, 0, 0]


STEMS = {"aa": ["kar", "tol", "min", "dek"], "bb": ["šuo", "žeč", "ňip", "ďal"], "cc": ["воз", "мир", "три", "дел"], "dd": ["गमन", "किताब", "पानी"]}


def speak(rnd, lang, n):
    return " ".join("".join(rnd.choice(STEMS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rnd = random.Random(5)
    rows = [(i, speak(rnd, lang, rnd.randrange(3, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc", "dd"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !!", "cc"), (903, speak(rnd, "cc", 9), None), (None, "kar tol", "zz"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame([(i, t, x, "x", "y", "z") for i, t, x in rows], "doc_id long, text string, lang string, spans string, score string, _text string")


def test_languages_of_held_out_texts(spoken):
    model = L.train(spoken)
    assert model.languages == ["aa", "bb", "cc", "dd"]  # the null id taught nothing
    rows = L.identify(spoken, model).collect()
    truth = {(r.doc_id, r.text): r.lang for r in spoken.collect()}
    assert len(rows) == len(truth) + 1  # one row comes twice
    lang = {i: x for (i, t), x in truth.items() if t and re.search(r"[^\W\d]", t)}
    lang[903], lang[None] = "cc", "aa"
    for r in rows:
        h = zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False
        assert r.held_out == h and 0 <= r.score <= 1
        assert r.lang_pred == lang.get(r.doc_id, "und")
        assert (r.score == 0 and r.spans == []) if r.lang_pred == "und" else r.score > 0.5


def test_counts_equal_plain_counts(spoken):
    model = L.train(spoken)
    wide = Counter()
    for r in spoken.collect():
        if r.lang == "aa" and r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            wide.update(L.letters(r.text.lower())[0].tolist())
    top = max(wide, key=wide.get)
    share = wide[top] / sum(wide.values())
    assert abs(math.exp(model.log_share[top, 0]) - (0.95 * share + 0.05 * share / 4 + L.FLOOR)) < 1e-9  # no other language shows it


def test_spans_of_mixed_texts(spoken):
    model, rnd = L.train(spoken), random.Random(8)
    for _ in range(20):
        langs = [rnd.choice(["aa", "bb", "cc", "dd"]) for _ in range(rnd.randrange(1, 6))]
        langs = [x for x, y in zip(langs, [None] + langs) if x != y]
        sizes = [rnd.randrange(12, 700) for _ in langs]
        text = " -- ".join(speak(rnd, x, n) for x, n in zip(langs, sizes))
        lang, _, spans = model.label([text])[0]
        assert [x for *_, x in spans] == langs and [n for _, n, _ in spans] == sizes
        assert lang in langs


def test_script_narrows_and_unknown_scripts_do_not(spoken):
    model = L.train(spoken)
    score, size = model.words(["три kar 漢字"])[0]
    assert size.tolist() == [3, 3, 2]
    assert np.isinf(score[0]).tolist() == [True, True, False, True]
    assert np.isinf(score[1]).tolist() == [False, False, True, True] and not np.isinf(score[2]).any()


def test_pieces_do_not_change_the_words(spoken, monkeypatch):
    model, rnd = L.train(spoken), random.Random(9)
    texts = [speak(rnd, rnd.choice(list(STEMS)), rnd.randrange(1, 90)) + rnd.choice(["", " ", "\n!"]) for _ in range(30)] + [None, "", "kar" * 50]
    want = model.words(texts[:-1])
    monkeypatch.setattr(L, "PIECE", 60)
    for (a, m), (b, n) in zip(want, model.words(texts)):
        assert m.tolist() == n.tolist() and np.allclose(a, b)
    assert model.label(texts[-1:])[0][0] == "aa"


def test_languages_of_a_very_long_text(spoken):
    rnd = random.Random(1)
    text = speak(rnd, "aa", 700_000) + " " + speak(rnd, "cc", 60_000)
    lang, score, spans = L.train(spoken).label([text, "kar", None])[0]
    assert lang == "aa" and score > 0.8 and spans == [(0, 700_000, "aa"), (700_000, 60_000, "cc")]


def test_languages_without_anything_to_learn(spark, docs, empty):
    assert L.identify(empty, L.train(empty)).collect() == []
    assert {(r.lang_pred, r.score) for r in L.identify(docs, L.train(empty)).collect()} == {("und", 0.0)}


# ---- centroids

def brute_clusters(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [math.floor(x * scale) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centre = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    if not centre:
        return Counter()
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(centre))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centre = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else w for j, w in enumerate(centre)]
    found = [(i, *near(v)) for i, v in kept]
    per = Counter()
    for _, d, j in found:
        per[j] += d
    fits = lambda x: x if x < 2 ** 63 else None
    return Counter((i, j, fits(d), fits(per[j]), fits(sum(per.values())), ",".join(map(str, centre[j]))) for i, d, j in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], "vec_id long, embedding array<double>, cluster string, ids string, places string")


@pytest.mark.parametrize("big", [1, 1e4, 1e12, 1e30])
def test_clusters_are_exact(spark, big):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) * rnd.choice([1, big]) for _ in range(5)]) for i in range(60)]
    rows += [(3, rows[7][1]), (3, rows[8][1]), (None, rows[3][1]), (100, None), (101, [1.0] * 4), (102, [1.0, None, 1.0, 1.0, 1.0]),
             (103, [math.nan] * 5), (104, [math.inf] * 5), (105, rows[9][1]), (106, []), (107, [0.0, -0.0, 1e-9, -1e-9, 1 / 1024])]
    df = vectors(spark, rows).repartition(3)
    for k, rounds, block in ((4, 5, 7), (80, 2, 4096), (1, 1, 10)):
        found = C.cluster_vectors(df, scratch_path(spark, "clusters"), k=k, rounds=rounds, dims=5, block=block)
        assert Counter(map(tuple, found.collect())) == brute_clusters(rows, k, rounds, 5)


def test_many_equal_vectors_and_empty_clusters(spark):
    rows = [(i, [0.5, 0.25]) for i in range(300)] + [(1000 + i, [float(i), -1.0]) for i in range(5)]
    found = C.cluster_vectors(vectors(spark, rows), scratch_path(spark, "clusters"), k=6, rounds=4, dims=2, block=16)
    assert Counter(map(tuple, found.collect())) == brute_clusters(rows, 6, 4, 2)


def test_no_vectors_give_no_rows(spark):
    for rows in ([], [(1, [1.0])], [(None, [1.0, 2.0])]):
        assert C.cluster_vectors(vectors(spark, rows), scratch_path(spark, "clusters"), dims=2).collect() == []


def test_float_vectors_are_scaled_as_doubles(spark):
    rows = [(i, [np.float32(0.1 * i).item(), np.float32(-0.3).item()]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = C.cluster_vectors(df, scratch_path(spark, "clusters"), k=3, rounds=3, dims=2)
    assert Counter(map(tuple, found.collect())) == brute_clusters(rows, 3, 3, 2)


def test_the_row_of_a_hot_id_in_every_block(spark):
    rows = [(7, [float(i % 11), 1.0]) for i in range(200)] + [(i, [float(i), 0.0]) for i in range(20)]
    found = C.cluster_vectors(vectors(spark, rows).repartition(5), scratch_path(spark, "clusters"), k=5, rounds=3, dims=2, block=9)
    assert Counter(map(tuple, found.collect())) == brute_clusters(rows, 5, 3, 2)

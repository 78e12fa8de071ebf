"""Every corpus operator against a plain brute-force version, odd rows and clashing columns included."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def got(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- token counts

def test_token_counts(docs, rows):
    import sentencepiece

    from feedloom.llm.token_counts import token_counts

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in rows)
    assert got(token_counts(docs, path), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    small = token_counts(docs, path, batch_bytes=300)  # many batches
    assert got(small, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_token_counts_of_a_json_vocabulary(docs, rows):
    from tokenizers import Tokenizer

    from feedloom.llm.token_counts import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert got(token_counts(docs, path), "doc_id", "n_tokens") == want


@pytest.mark.parametrize("limit", [1, 5, 40])
def test_parts_keep_the_count(rows, limit, monkeypatch):
    import sentencepiece

    from feedloom.llm import token_counts as tc

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    monkeypatch.setattr(tc, "SPLIT_BYTES", limit)
    monkeypatch.setattr(tc, "_LOADED", {})
    texts = [t[:3000] for _, t in rows if t]
    assert tc.encoder("x.model", model)(texts) == [len(x) for x in sp.encode(texts)]


# ---- substring dedup

def brute_substrings(rows, span=50):
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            s = b[k:k + span]
            least[s] = min(least.get(s, float("inf")), order(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if least[b[k:k + span]] < order(i):
                mark[k:k + span] = True
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        spans = int((np.diff(mark.astype(int), prepend=0) == 1).sum())
        out[i, len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("section,bucket", [(None, None), (1, 700)])
def test_substring_dedup(docs, rows, tmp_path, section, bucket):
    from feedloom.llm.substrings import substring_dedup

    if section:  # many files, sections and buckets: copies meet in the settling of triggers and of strings too
        docs.repartition(25, "n_chars").write.parquet(str(tmp_path / "many"))
        docs = docs.sparkSession.read.option("maxPartitionBytes", "1").parquet(str(tmp_path / "many"))
    df = substring_dedup(docs, str(tmp_path / "w"), section_bytes=section, bucket_bytes=bucket)
    assert got(df, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_substrings(rows)


def test_substring_text(docs, rows, tmp_path):
    from feedloom.llm.substrings import substring_dedup

    for r in substring_dedup(docs, str(tmp_path / "w"), with_text=True).collect():
        if r.n_removed == 0:
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert (r.doc_id, r.text_crc32) in {(i, zlib.crc32((t or "").encode())) for i, t in rows}


def test_parse_is_prefix_free(rows):
    from feedloom.llm.substrings import SPAN, Parse

    texts = [(t or "").encode() for _, t in rows]
    p = Parse(texts)
    at, phrase = p.strings(np.arange(len(p.begin)))
    starts = np.cumsum([0] + [len(t) for t in texts])
    want = [a + k for a, t in zip(starts, texts) for k in range(len(t) - SPAN + 1)]
    assert sorted(at.tolist()) == want  # every string lies in exactly one phrase
    whole = b"".join(texts)
    trigger = {}
    for a, ph in zip(at.tolist(), phrase.tolist()):
        assert trigger.setdefault(whole[a:a + SPAN], p.trigger[ph]) == p.trigger[ph]


@pytest.mark.parametrize("values", [256, 3, 1])
def test_substrings_with_equal_hashes(rows, monkeypatch, values):
    """Bytes decide, also where the rolling hash tells few or no strings apart; long phrases are cut into pieces."""
    from feedloom.llm import substrings as sub

    monkeypatch.setattr(sub, "_BYTE", sub._BYTE[np.arange(256) % values])
    monkeypatch.setattr(sub, "PIECE", 40)
    rows = [r for r in rows if len(r[1] or "") < 3000][:60] + [(3, "ab" * 400), (9, "x" + "ab" * 300), (None, "ab" * 60), (12, "a" * 300), (4, "a" * 70)]
    rows += [(200, rows[0][1]), (7, "c" * 49), (8, "c" * 49), (None, None)]
    buckets, chunks, held = 3, {}, []
    for k in range(0, len(rows), 4):
        ids, texts = [i for i, _ in rows[k:k + 4]], [(t or "").encode() for _, t in rows[k:k + 4]]
        chunks[k] = (ids, texts, sub.Parse(texts))
        held.append((k, b"", chunks[k][2], sub._order(ids), b"".join(texts)))
    parts = [r for k in range(0, len(held), 3) for r in sub.section(held[k:k + 3], buckets).to_pylist()]
    tables = [pa.Table.from_pylist([r for r in parts if r["bucket"] == b], pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in sub.PARTS[1:]]))
              for b in range(buckets)]
    found = [r for t in tables for r in sub.settle_triggers(t).to_pylist()]
    entries = []
    for k, (ids, texts, p) in chunks.items():
        todo = sub._places([r for r in found if r["chunk"] == k], "open")
        if len(todo):
            entries += [dict(zip(sub.ENTRIES, r)) for r in sub.phrase_rows(k, p, sub._order(ids), b"".join(texts), todo, buckets)]
    for b in range(buckets):
        mine = [r for r in entries if r["bucket"] == b]
        if mine:
            found += sub.settle_phrases(pa.Table.from_pylist(mine)).to_pylist()
    out = Counter()
    for k, (ids, texts, p) in chunks.items():
        own = [r for r in found if r["chunk"] == k]
        mark = sub.removed_runs(p, *(sub._places(own, kind) for kind in ("gone", "piece", "string")), sum(map(len, texts)))
        end = 0
        for i, t in zip(ids, texts):
            m, end = mark[end:end + len(t)], end + len(t)
            out[i, len(t), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()),
                hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()] += 1
    assert out == brute_substrings(rows)


def test_rows_in_another_order_are_noticed(spark):
    from feedloom.llm.substrings import _texts

    with pytest.raises(ValueError):
        _texts({"sizes": [0], "texts": b"", "check": b"a", "found": [{"check": b"b"}]})


# ---- license scan

def test_license_report(docs, rows):
    from feedloom.llm.licenses import NAMES, PHRASES, TEMPLATES, THRESHOLD, license_report

    sets = [(label, set(t.split())) for label, ts in TEMPLATES.items() for t in ts]
    want = Counter()
    for i, t in rows:
        w = ALNUM_WORD.findall(low(t))
        at = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        base, own, best = {x for _, x in at}, set(), 0.0
        for block in (t or "").split("\n"):
            b = set(ALNUM_WORD.findall(low(block)))
            for label, s in sets:
                if len(b & s) >= THRESHOLD * len(s) - 1e-9 and NAMES & s <= b:
                    own.add(label)
                    best = max(best, len(b & s) / len(s))
        first, last = (min(k for k, _ in at), max(k for k, _ in at)) if at else (None, None)
        want[i, len(w), len(at), first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), max(best, 1.0 if at else 0.0)] += 1
    df = license_report(docs)
    assert got(df, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == want
    assert sum(k[2] for k in want) >= 4 and any("rights-reserved" in k[6] for k in want)


def test_license_notices_over_several_lines(make):
    from feedloom.llm.licenses import TEMPLATES, license_report

    def wrap(text, n):
        w = text.split(" ")
        return "".join(f"\n * {' '.join(w[k:k + n])}" for k in range(0, len(w), n))

    notices = [(label, t) for label, ts in TEMPLATES.items() for t in ts if len(t.split()) >= 20]
    rows = [(k, "Some words before." + wrap(t, 7) + "\nand after") for k, (_, t) in enumerate(notices)]
    far = notices[0][1].split(" ")  # all its tokens, but not in a row
    rows += [(90, "\n".join(w + " x y z u v" for w in far)), (91, "nothing here")]
    out = {r.doc_id: r for r in license_report(make(rows, "wrapped")).collect()}
    assert len(notices) >= 4 and all(label in out[k].labels.split(",") and out[k].score == 1.0 for k, (label, _) in enumerate(notices))
    assert (out[90].labels, out[90].score, out[91].labels, out[91].score) == ("", 0.0, "", 0.0)


def test_license_sql_knows_names_and_runs(make):
    import duckdb

    from feedloom.llm.licenses import TEMPLATES, license_report
    from feedloom.llm.oracle import SQL

    mit, apache = TEMPLATES["mit-notice"][0], TEMPLATES["apache-notice"][0]
    wrap = lambda t, n: "\n * ".join(" ".join(t.split(" ")[k:k + n]) for k in range(0, len(t.split(" ")), n))
    texts = {1: "It is released under the apache license", 2: "Code released under the GPL license.", 3: "x\n" + wrap(mit, 6) + "\ny", 4: "all\nrights\nreserved",
             5: "This is RELEASED under the MIT License!", 6: "released under the\nmit\nlicense", 7: wrap(apache, 4).replace("apache", "other"),
             8: wrap(apache.replace(" may", " can"), 5), 9: "licensed under cc by nc 4 0", 10: "licensed under cc 4 0", 11: None, 12: "mit " + "z " * 9 + "released under the license"}
    got_rows = {r.doc_id: r.asDict() for r in license_report(make(list(texts.items()), "probes")).collect()}
    labels = {k: r["labels"] for k, r in got_rows.items()}
    assert labels == {1: "apache", 2: "", 3: "mit-notice", 4: "rights-reserved", 5: "mit,mit-notice", 6: "mit,mit-notice", 7: "", 8: "apache,apache-notice",
                      9: "cc-by,cc-by-nc-notice,cc-by-notice", 10: "", 11: "", 12: "mit-notice"}  # a line is a set of words
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(texts.items()))
    res = con.execute(SQL["op3_license_scan"])
    names = [d[0] for d in res.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in res.fetchall()}
    assert {k: {c: r[c] for c in names} for k, r in got_rows.items()} == want


# ---- quality classifier

def test_trees_learn_and_walk():
    from feedloom.llm.quality_model import fit

    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    m = fit(x[:2000], y[:2000])
    s = m.score(x[2000:])
    assert ((s > 0.5) == y[2000:]).mean() > 0.85
    # the flat walk equals a walk row by row
    for row, p in list(zip(x[2000:], s))[:50]:
        total = m.base
        for f, c, leaf in zip(m.feature, m.cut, m.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > c[node])
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - p) < 1e-12


def test_quality_classifier(spark):
    from feedloom.llm.queries import op4

    d = "/root/testdata/sf0.01"
    r = op4(spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = r[r.quality == 1].score.values, r[r.quality == 0].score.values
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert set(r.predicted) <= {0, 1} and (r.predicted == (r.score >= 0.3)).all()


def test_quality_classifier_odd_rows(spark, docs, rows, empty):
    from feedloom.llm.quality_model import fold, score, train
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i, _ in rows if i is not None] + [(None, 1)], "doc_id long, quality long")
    model = train(docs, labels)
    out = score(docs, model).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in out)
    held = {i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 0 for i, _ in rows}
    assert all(r.held_out == held[r.doc_id] for r in out)
    assert {r.score for r in score(docs, train(docs, labels.limit(0))).collect()} == {0.5}
    assert score(empty, train(empty, labels)).count() == 0
    # a held-out label never changes the model
    flipped = labels.withColumn("quality", F.when(fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    other = train(docs, flipped)
    assert all(np.array_equal(getattr(model, a), getattr(other, a)) for a in ("base", "feature", "cut", "leaf"))


# ---- near duplicates

def shingles(t, size):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_near(rows, percent, size):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = i if least[r] is None else min(i, least[r])
    return Counter((i, len(sets[k]), least[find(k)], least[find(k)] == i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("percent,size", [(85, 3), (80, 5)])
def test_near_duplicates(docs, rows, tmp_path, percent, size):
    from feedloom.llm.near_duplicates import near_duplicates

    want = brute_near(rows, percent, size)
    assert got(near_duplicates(docs, str(tmp_path / "n"), percent, size), "doc_id", "n_shingles", "component_id", "kept") == want
    assert sum(1 for k in want if not k[3]) >= 5


def test_links_beyond_the_first_of_a_bucket(make, tmp_path):
    """Chains a-b-c in which the ends are not linked, and pairs that meet only under a foreign smallest member."""
    from feedloom.llm.near_duplicates import near_duplicates

    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(30):
        t = list(base)
        for k in range(i * 5, i * 5 + 5):
            t[(k * 7) % 200] = f"z{k // 2}"
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(base[:60 + 5 * i])) for i in range(25)]
    want = brute_near(rows, 80, 3)
    assert got(near_duplicates(make(rows, "chain"), str(tmp_path / "n"), 80, 3), "doc_id", "n_shingles", "component_id", "kept") == want


def test_components_of_a_long_path(spark, tmp_path):
    from feedloom.llm.components import components

    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 501)], "a int, b int")
    out = {r.node: r.root for r in components(links, str(tmp_path / "c")).collect()}
    assert out == {**{k: 0 for k in range(201)}, 500: 500, 501: 500, 900: 500}


# ---- packing

def test_packing(docs, rows):
    from tokenizers import Tokenizer

    from feedloom.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    ids = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t in rows]
    out = pack(docs, path).collect()
    seqs, pieces = defaultdict(list), defaultdict(Counter)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens][r.start, r.length, r.ids_crc32] += 1
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == np.cumsum([0] + [n for _, n in sorted(s)])[:-1].tolist()
        n = sum(n for _, n in s)
        assert n == 2048 or n & (n - 1) == 0
    # every id of every document lies in exactly one piece
    for key, own in pieces.items():
        same = [x for i, x in ids if (i, len(x)) == key]
        assert sum(n * c for (_, n, _), c in own.items()) == len(same) * key[1]
        assert all(any(zlib.crc32(x[a:a + n].tobytes()) == c for x in same) for a, n, c in own)
    assert Counter(k for k in pieces) == Counter({(i, len(x)): 1 for i, x in ids})


def test_assignment_is_exact_and_balanced():
    from feedloom.llm.packing import assign, cost

    rnd = np.random.default_rng(1)
    n = rnd.integers(1, 3000, 400).tolist()
    p = assign(n)
    load, held = defaultdict(int), defaultdict(list)
    for doc, start, length, seq, offset in p:
        load[seq] += length
        held[doc].append((start, length))
    assert sum(load.values()) == sum(n)
    for doc, parts in held.items():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0] + [k for _, k in parts])[:-1].tolist() and sum(k for _, k in parts) == n[doc]
    short = [seq for seq, k in load.items() if k == 2048 and not any(x[3] == seq and x[2] == 2048 for x in p)]
    costs = [sum(cost(x[2]) for x in p if x[3] == seq) for seq in short]
    assert max(costs) < 2 * (sum(costs) / len(costs))


# ---- quality rules

def test_quality_rules(docs, rows):
    from feedloom.llm.quality_rules import quality_report

    want = Counter()
    for i, t in rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        seen = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        cover = {x for k in range(len(w) - 7) if seen[tuple(w[k:k + 8])] > 1 for x in range(k, k + 8)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), failed] += 1
    out = quality_report(docs).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in names) for r in out) == want
    assert all(not (r.base_failed and r.kept) for r in out)
    assert not next(r for r in out if r.doc_id == 14).kept  # shouting
    assert all(r.kept for r in out if r.doc_id is not None and 20 <= r.doc_id < 60 and not r.base_failed)


def test_line_rules(spark):
    from pyspark.sql import functions as F

    from feedloom.llm.quality_rules import with_quality

    good = "This line is running text of a page about nothing."
    bad = ["BUY!! NOW!! HERE!!", "Home | About | News | Shop", "a%%% b$$$ c***", "no no no no no no", "All rights reserved."]
    good2 = "Another line of plain words that nobody would call a menu at all, ever."
    rows = [(1, "\n".join([good, *bad, good2])), (2, "\n".join(bad) + "\n" + good), (3, None), (4, "")]
    out = {r.doc_id: r for r in with_quality(spark.createDataFrame(rows, "doc_id int, text string").withColumn("quality", F.lit("clash"))).collect()}
    assert out[1].quality.cleaned == good + "\n" + good2 and out[1].quality.kept
    assert out[2].quality.cleaned == good and not out[2].quality.kept
    assert out[3].quality.cleaned is None and out[4].quality.cleaned == "" and not out[3].quality.kept


# ---- decontamination

def brute_leaks(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k:k + window])].add(i)
    out = Counter()
    for i, t in rows:
        w = ALNUM_WORD.findall(low(t))
        cover, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    cover |= set(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        out[i, len(w), len(cover), tuple(sorted(x for x in found if x is not None)), bool(cover)] += 1
    return out


ITEMS = [("a", None), ("b", ""), ("c", "one TWO"), (None, "no id here"), ("e", "licensed under the apache license version 2 0")]


@pytest.mark.parametrize("block", [4 << 20, 150])
def test_decontamination(spark, docs, rows, tmp_path, block):
    from feedloom.llm.decontaminate import decontaminate

    items = ITEMS + [("p", rows[7][1]), ("p2", " ".join(rows[25][1].split()[3:30])), ("p3", "same words here " * 4), ("c", "one TWO")]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id string, text string, n_words string")
    df = decontaminate(docs, bench, str(tmp_path / "i"), block_bytes=block)
    have = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect())
    want = brute_leaks(rows, items)
    assert have == want and sum(k[4] for k in want) >= 5


def test_proximity(spark, make, tmp_path):
    from feedloom.llm.decontaminate import build_index, search

    docs = make([(1, "alpha beta gamma delta"), (2, "alpha beta xx gamma delta"), (3, "alpha beta xx yy zz gamma delta"), (4, "delta gamma beta alpha"),
                 (5, "alpha beta"), (6, "gamma delta")], "near")
    index = build_index(docs)
    find = lambda slop: {r.doc_id for r in search(index, [("q", "alpha beta gamma delta")], slop=slop).collect() if r["items"]}
    assert find(0) == {1} and find(1) == {1, 2} and find(3) >= {1, 2, 3}


def brute_proximity(rows, items, slop, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k:k + window])].add(i)
    out = Counter()
    for i, t in rows:
        w, found = ALNUM_WORD.findall(low(t)), set()
        at = defaultdict(set)
        for p, x in enumerate(w):
            at[x] |= {p + d for d in range(-slop, slop + 1)}
        for win, of in wins.items():
            if set.intersection(*({p - k for p in at.get(x, ())} for k, x in enumerate(win))):
                found |= of
        out[i, tuple(sorted(x for x in found if x is not None))] += 1
    return out


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_columns(spark, make, tmp_path, slop):
    """``near_items`` against brute force: passages with words put in, left out and exchanged; exact columns stay."""
    import random

    from feedloom.llm.decontaminate import decontaminate

    rnd = random.Random(slop)
    text = [f"w{rnd.randrange(25)}" for _ in range(60)]
    items = ITEMS + [("p", " ".join(text)), ("q", " ".join(text[20:45])), ("r", "w1 w2 w3")]
    rows = [(0, None), (1, ""), (2, "one xx two"), (3, "two one"), (4, " ".join(text))]
    for i in range(5, 60):
        t = [f"w{rnd.randrange(25)}" for _ in range(rnd.randrange(9))] + text[rnd.randrange(30):][:rnd.randrange(8, 30)]
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(t))
            t[k:k + rnd.randrange(2)] = [f"z{i}"] * rnd.randrange(2)
        if i % 4 == 0:
            k = rnd.randrange(len(t) - 1)
            t[k], t[k + 1] = t[k + 1], t[k]
        rows.append((i, " ".join(t)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate(make(rows, "close"), bench, str(tmp_path / "i"), near=slop, block_bytes=200).collect()
    assert Counter((r.doc_id, tuple(r.near_items)) for r in found) == brute_proximity(rows, items, slop)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found) == brute_leaks(rows, items)


def test_stored_index_is_read_in_small_parts(spark, tmp_path):
    """A task's segments go to row groups of a few MB and one value each: nothing holds the postings of all of them as rows."""
    import random

    import pyarrow.parquet as pq

    from feedloom.llm.decontaminate import GROUP_BYTES, build_index, decontaminate, packed_postings, postings

    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.getrandbits(40):x}" for _ in range(20_000)) for _ in range(90)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path).coalesce(1)
    assert {"terms", "counts", "steps"}.isdisjoint(build_index(docs).columns)
    bench = spark.createDataFrame([("p", " ".join(texts[41].split()[50:70]))], "item_id string, text string")
    found = decontaminate(docs, bench, str(tmp_path / "i"), near=2).filter("contaminated").collect()
    assert [(r.doc_id, r.n_hit, r["items"], r.near_items) for r in found] == [(41, 20, ["p"], ["p"])]
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "i").glob("*.parquet")]
    sizes = [(m.row_group(g).num_rows, m.row_group(g).total_byte_size) for m in groups for g in range(m.num_row_groups)]
    assert sum(b for _, b in sizes) > 2 * GROUP_BYTES and all(b < GROUP_BYTES or n <= 3 for n, b in sizes) and len(sizes) > 1
    for terms, n, steps in (([], [], []), ([b"a", "\u7684é".encode()], [1, 2], [5, 4, 9])):
        a, b, c = postings(packed_postings(terms, np.array(n, np.int64), np.array(steps, np.int64)))
        assert (a, b.tolist(), c.tolist()) == (terms, n, steps)


# ---- web archive

def test_archive_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    from feedloom.llm.warc import read_archive, record_bytes, write_archive

    big, other = "<p>é</p>" * 30, "<b>x</b>" * 40
    pages = [(5, "u5", big), (3, "u3", big), (3, "u3", big), (9, None, big), (1, "u\r\n1", "short"), (2, "u2", "short"), (4, "u4", None),
             (6, "u6", ""), (None, "n", big), (None, "n", other), (7, "u7", "long " * 50000)]
    src = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("digest", "payload", "owner", "record_type", "header", "n_bytes", "key"):
        src = src.withColumn(c, F.lit("clash"))
    path = str(tmp_path / "a")
    write_archive(src, path)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert Counter(r.digest for r in spark.read.parquet(path + "/payloads").collect()) == Counter({sha(t) for _, _, t in pages})
    back = read_archive(spark, path)
    least = {}
    for i, _, t in pages:
        least.setdefault(t or "", []).append(i)
    want = Counter()
    for i, _, t in pages:
        n = len((t or "").encode())
        ids = [x for x in least[t or ""] if x is not None]
        owner = min(ids) if ids else None
        response = n < 100 or i == owner
        want[i, n, sha(t), "response" if response else "revisit", None if response else str(owner)] += 1
    assert got(back, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    whole = back.withColumn("r", record_bytes(F.col("header"), F.col("record_type"), F.col("payload"))).collect()
    for r in whole:
        head, _, rest = bytes(r.r).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head == r.header.encode() and rest.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == int(fields[b"Content-Length"])
        assert b"sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest().encode() == fields[b"WARC-Payload-Digest"]
        if r.record_type == "response":
            assert rest[:-4] == bytes(r.payload)


def test_archive_notices_damage(spark, tmp_path):
    from feedloom.llm.warc import read_archive, write_archive

    path = str(tmp_path / "a")
    write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), path)
    damaged = spark.read.parquet(path + "/payloads").selectExpr("digest", "cast('y' as binary) payload").collect()
    spark.createDataFrame(damaged, "digest string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, path).collect()


# ---- compact windows

def test_compact_windows_partition_all_sequences():
    from feedloom.llm.passages import compact_windows

    rnd = np.random.default_rng(3)
    counts = np.array([0, 3, 40, 1, 25, 7])
    h = rnd.integers(0, 1 << 62, counts.sum(), dtype=np.uint64)
    h[10:14] = h[20]
    for least in (1, 4, 7):
        text, value, first, last = compact_windows(h, counts, least)
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends)):
            own = [(v, f, e) for t, v, f, e in zip(text, value, first, last) if t == k]
            x = h[a:b]
            for i in range(len(x)):
                for j in range(i + least - 1, len(x)):
                    assert any(f <= i and j <= e and v == x[i:j + 1].min() for v, f, e in own)
            assert all(e - f + 1 >= least for _, f, e in own)


def test_compare_finds_passages_one_by_one():
    from feedloom.llm.passages import compare

    rnd = np.random.default_rng(5)
    a, b, c = (rnd.permutation(rnd.integers(0, 1 << 60, 60, dtype=np.uint64)) for _ in range(3))
    far = rnd.integers(0, 1 << 60, 5000, dtype=np.uint64)
    # neighbours in one text, far apart in the other, and the other way round
    assert compare(np.concatenate([a, far, b]), np.concatenate([a, b]), 46) == [(0, 60, 0, 60, 1.0), (5060, 5120, 60, 120, 1.0)]
    assert compare(np.concatenate([b, a]), np.concatenate([a, far, b]), 46) == [(60, 120, 0, 60, 1.0), (0, 60, 5060, 5120, 1.0)]
    assert compare(np.concatenate([c, a, far]), np.concatenate([far[:3], a]), 46) == [(60, 120, 3, 63, 1.0)]
    near = a.copy()
    near[[7, 30, 44]] = far[:3]
    (lo, hi, p, q, s), = compare(np.concatenate([c, a]), np.concatenate([b, near]), 46)
    assert (lo, hi, p, q) == (60, 120, 60, 120) and s == 57 / 63
    assert compare(a, b, 46) == []


@pytest.mark.parametrize("size", [50, 60, 75])
def test_compare_finds_passages_with_one_changed_word(size):
    import random

    from feedloom.llm.passages import compare
    from feedloom.llm.shingles import shingle_hashes, word_hashes

    rnd = random.Random(size)
    word = lambda: "w" + str(rnd.randrange(10 ** 9))
    passage = [word() for _ in range(size)]
    for k in range(size):
        other = passage[:k] + ["new"] + passage[k + 1:]
        for before, after in ((30, 40), (0, 0)):
            a, b = ([word() for _ in range(before)] + p + [word() for _ in range(after)] for p in (passage, other))
            h, n = shingle_hashes(*word_hashes([" ".join(a).encode(), " ".join(b).encode()]), 5)
            (lo, hi, p, q, s), = compare(h[:n[0]], h[n[0]:], 46)
            assert q - p >= 46 and s >= 0.8 and lo == p and hi == q
            assert p <= before + (k + 1 if k < 5 else 0) and q >= before + size - 4 - (size - k if k > size - 6 else 0)


def test_compare_meets_every_place_of_a_token(monkeypatch):
    from feedloom.llm import passages

    rnd = np.random.default_rng(8)
    a, far = rnd.integers(0, 1 << 60, 56, dtype=np.uint64), rnd.integers(0, 1 << 60, 400, dtype=np.uint64)
    near = lambda x, y: passages.compare(np.concatenate(x), np.concatenate(y), 46)
    for limit in (1 << 20, 40):
        monkeypatch.setattr(passages, "MATCHES", limit, raising=False)
        # a first part earlier, the whole later; the whole twice
        assert near([a[:26], far[:200], a], [far[300:], a]) == [(226, 282, 100, 156, 1.0)]
        assert near([a[:20], far[:3], a], [a]) == [(23, 79, 0, 56, 1.0)]
        assert near([a, far[:200], a], [a]) == [(0, 56, 0, 56, 1.0), (256, 312, 0, 56, 1.0)]
        line = np.tile(a[:7], 30)
        assert (0, 210, 0, 210, 1.0) in near([line], [line])


def test_near_passages(docs, rows, make):
    from feedloom.llm.passages import near_passages

    out = near_passages(docs).collect()
    assert len(out) == len(set(out)) and all(r.similarity >= 0.8 and r.n_words >= 50 and r.partner_id < r.doc_id for r in out)
    passage = rows[7][1]
    holders = {i for i, t in rows if t and i is not None and len(t.split()) >= 50 and passage in " ".join(t.split())}
    assert holders == {7, 16} | {i for i in holders} and len(holders) > 8
    assert holders - {min(holders)} <= {r.doc_id for r in out} and min(holders) in {r.partner_id for r in out}
    text = {i: (t or "").split() for i, t in rows}
    for r in out:  # confirmed on the words themselves
        a = shingles(" ".join(text[r.doc_id][r.first_word:r.first_word + r.n_words]), 5)
        b = shingles(" ".join(text[r.partner_id][r.partner_first:r.partner_first + r.partner_words]), 5)
        if r.doc_id not in (6, 16):  # these hold white space that Python's split() takes for more
            assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9


def test_copies_are_paired_beside_a_smaller_holder_of_their_values(make):
    """Exact copies whose min-hash values are held by smaller documents too: a variant that is no near duplicate, unrelated documents
    with a stock phrase each, and many documents with a common line."""
    import random

    from feedloom.llm.passages import near_passages

    rnd = random.Random(11)
    new = lambda n: ["w" + str(rnd.randrange(10 ** 9)) for _ in range(n)]
    out, want = [], set()

    def add(*parts):
        out.append((len(out), " ".join(w for p in (new(8), *parts, new(8)) for w in p)))
        return out[-1][0]

    for _ in range(12):
        passage = new(60)
        add([new(1)[0] if k in (15, 30, 45) else w for k, w in enumerate(passage)])
        want.add((add(passage), add(passage)))
    for _ in range(12):
        stock = [new(9) for _ in range(7)]
        for p in stock:
            add(new(30), p, new(30))
        want.add((add(*stock), add(*stock)))
    line = new(16)
    for k in range(120):
        add(new(30), line, new(30))
        if k % 20 == 0:
            before, after = new(17), new(17)
            want.add((add(before, line, after), add(before, line, after)))
    found = {(r.partner_id, r.doc_id) for r in near_passages(make(out, "beside")).collect()}
    assert found == want


def test_passages_that_nearly_repeat_share_a_class(make):
    """Variants of one passage, each near to some others only, copies of whole texts, and near lists of few short lines: whatever
    ``compare`` links, all pairs tried, has one class."""
    import random

    from feedloom.llm.passages import compare, near_passages
    from feedloom.llm.shingles import shingle_hashes, word_hashes

    rnd = random.Random(23)
    new = lambda n: ["w" + str(rnd.randrange(10 ** 9)) for _ in range(n)]
    out = []
    for _ in range(3):
        passage = new(64)
        for k in range(14):  # two variants with the same changes are near, others may not be
            changed = {rnd.choice((9, 20, 31, 42, 53)) for _ in range(rnd.randrange(3))}
            out.append(new(20) + ["x" + str(i) if i in changed else w for i, w in enumerate(passage)] + new(20))
    out += [out[k] for k in (3, 3, 20)]
    lines = [new(5) for _ in range(5)]
    for _ in range(5):
        out.append(new(9) + [w for _ in range(60) for w in rnd.choice(lines)] + new(9))
    out.append(new(200))
    texts = list(enumerate(" ".join(t) for t in out))
    h, n = shingle_hashes(*word_hashes([t.encode() for _, t in texts]), 5)
    tokens = np.split(h, np.cumsum(n)[:-1])
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if want[a] != want[b] and compare(tokens[a], tokens[b], 46):
                low, high = sorted((want[a], want[b]))
                want = [low if c == high else c for c in want]
    found = list(range(len(texts)))
    for r in near_passages(make(texts, "variants")).collect():
        found[r.doc_id] = found[r.partner_id] = r.class_id
    assert found == want and len(set(want)) < len(want) - 40


def test_connected_documents_are_not_compared_again(make, monkeypatch):
    """Two documents that passages of a third one connect share a line too: one class, and no comparison of the two."""
    import random

    from feedloom.llm import passages

    rnd = random.Random(31)  # every token that 1 and 2 share stands for a common run in 0 too
    new = lambda n: ["w" + str(rnd.randrange(10 ** 9)) for _ in range(n)]
    line, one, two = new(24), new(60), new(60)
    parts = [[*new(20), *one, *new(60), *line, *new(60), *two, *new(20)], [*new(20), *one, *new(70), *line, *new(20)],
             [*new(20), *line, *new(70), *two, *new(20)], new(200)]
    plain, seen = passages.compared, []

    def compared(pairs, texts, least):
        seen.extend((r.a, r.b) for r in pairs.select("a", "b").collect())
        return plain(pairs, texts, least)

    monkeypatch.setattr(passages, "compared", compared)
    found = passages.near_passages(make([(k, " ".join(t)) for k, t in enumerate(parts)], "connected")).collect()
    assert {(r.doc_id, r.partner_id, r.class_id) for r in found} == {(1, 0, 0), (2, 0, 0)}
    assert sorted(seen) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("holders", [0, 12])
def test_passages_of_connected_documents_are_found(make, holders):
    """Two documents that other passages connect over a third share a passage of which the third has the common run only (so do
    ``holders`` more, which makes it a run of many): the passage has a row."""
    import random

    from feedloom.llm.passages import near_passages

    rnd = random.Random(holders)
    new = lambda n: ["w" + str(rnd.randrange(10 ** 9)) for _ in range(n)]
    out, want, places = [], set(), {}

    def add(*parts):
        out.append((len(out), " ".join(w for p in parts for w in (*new(30), *p))))
        return out[-1][0]

    for _ in range(4):
        one, two, head, line = new(60), new(60), new(20), new(29)
        a = add(one, two, line)
        b, c = add(one, [*head, "x", *line]), add(two, [*head, "y", *line])
        want |= {(a, b), (a, c), (b, c)}
        places[b, c] = 30 + 60 + 30
        for _ in range(holders):
            add(line)
    found = near_passages(make(out, "connected")).collect()
    assert {(r.partner_id, r.doc_id) for r in found} == want
    for r in found:
        if (r.partner_id, r.doc_id) in places:
            assert r.first_word <= places[r.partner_id, r.doc_id] + 20 and r.n_words >= 50


def test_near_passages_lie_in_rows(make):
    """Of every passage that ``compare`` names, all pairs tried, both middles lie in rows: of the two documents, or of each with one
    smaller document."""
    import random

    from feedloom.llm.passages import compare, near_passages
    from feedloom.llm.shingles import shingle_hashes, word_hashes

    rnd = random.Random(41)
    new = lambda n: ["w" + str(rnd.randrange(10 ** 9)) for _ in range(n)]
    stock = [new(rnd.choice((26, 30, 52, 70))) for _ in range(9)]
    out = []
    for _ in range(45):
        t = []
        for p in rnd.sample(stock, 4):
            p = list(p)
            for _ in range(rnd.randrange(3)):
                p[rnd.randrange(len(p))] = new(1)[0]
            t += [*p, *new(rnd.choice((0, 1, 25)))]
        out.append(t)
    texts = list(enumerate(" ".join(t) for t in out))
    h, n = shingle_hashes(*word_hashes([t.encode() for _, t in texts]), 5)
    tokens = np.split(h, np.cumsum(n)[:-1])
    rows = defaultdict(list)
    for r in near_passages(make(texts, "stock")).collect():
        rows[r.doc_id].append((r.partner_id, r.first_word, r.first_word + r.n_words))
        rows[r.partner_id, r.doc_id].append((r.partner_first, r.partner_first + r.partner_words))
    assert rows
    tried = 0
    for b in range(len(texts)):
        for a in range(b):
            for lo, hi, first, end, _ in compare(tokens[a], tokens[b], 46):
                at, to = (lo + hi + 4) // 2, (first + end + 4) // 2
                over_b = {p for p, f, e in rows[b] if f <= to < e}
                over_a = {p for p, f, e in rows[a] if f <= at < e}
                tried += 1
                assert a in over_b or over_a & over_b, (a, b, lo, hi, first, end)
    assert tried > 100


def test_common_words_of_near_passages():
    """Every near duplicate of 50 words, by changes of words, has a common run of so many words; each run has a common root."""
    from feedloom.llm.passages import common_words, compare, long_tokens, roots
    from feedloom.llm.shingles import shingle_hashes

    rnd = np.random.default_rng(4)
    words = common_words(46)
    assert words == 24 and sum(long_tokens(46)) == words + 1
    size, run = long_tokens(46)
    for _ in range(60):
        a = rnd.integers(1, 1 << 60, int(rnd.integers(50, 160)), dtype=np.uint64)
        b = a.copy()
        at = rnd.integers(0, len(a), int(rnd.integers(1, 5)))
        b[at] = rnd.integers(1, 1 << 60, len(at), dtype=np.uint64)
        x, y = (shingle_hashes(t, np.array([len(t)]), 5)[0] for t in (a, b))
        if not compare(x, y, 46):
            continue
        assert np.diff(np.concatenate([[-1], np.unique(at), [len(a)]])).max() - 1 >= words
        p, q = (shingle_hashes(t, np.array([len(t)]), size)[0] for t in (a, b))
        assert set(p[roots(p, np.array([len(p)]), run)[1]].tolist()) & set(q[roots(q, np.array([len(q)]), run)[1]].tolist())


def test_functions_of_passages_keep_the_chance_of_a_miss():
    from feedloom.llm import passages as P

    s, n = P.PERCENT / 100, P.HASHES
    assert (1 - s) ** n + n * s * (1 - s) ** (n - 1) <= 5e-5 and P.NEED == 2
    assert (1 - s ** P.ROWS) ** P.BANDS <= 5e-5


# ---- empty tables

@pytest.mark.parametrize("name", ["tokens", "substrings", "licenses", "near", "pack", "rules", "leaks", "passages"])
def test_empty_table(spark, empty, tmp_path, name):
    from feedloom.llm import decontaminate, licenses, near_duplicates, packing, passages, quality_rules, substrings, token_counts

    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    run = {"tokens": lambda: token_counts.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")),
           "substrings": lambda: substrings.substring_dedup(empty, str(tmp_path / "s")), "licenses": lambda: licenses.license_report(empty),
           "near": lambda: near_duplicates.near_duplicates(empty, str(tmp_path / "n")),
           "pack": lambda: packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")), "rules": lambda: quality_rules.quality_report(empty),
           "leaks": lambda: decontaminate.decontaminate(empty, bench, str(tmp_path / "i")), "passages": lambda: passages.near_passages(empty)}
    assert run[name]().collect() == []


def test_empty_pages_and_benchmark(spark, docs, tmp_path):
    from feedloom.llm.decontaminate import decontaminate
    from feedloom.llm.warc import read_archive, write_archive

    write_archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"))
    assert read_archive(spark, str(tmp_path / "a")).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate(docs, none, str(tmp_path / "i")).filter("contaminated or n_hit > 0").count()

"""The pipeline, stage by stage, against brute force; its results on an empty table; the entry's guard."""

import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np

import corpus_pipeline as P
from test_llm_operators import brute_leaks, brute_near

REPO = Path(__file__).resolve().parents[2]
ITEMS = [("a", None), ("w", "One of the words"), ("leak", "leaked words of a test item that nobody should train on at all")]


def folder(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(tmp_path / "sf" / "benchmark.parquet"))
    return str(tmp_path / "sf")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def brute_cut(rows, span=50):
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            least[b[k:k + span]] = min(least.get(b[k:k + span], float("inf")), order(i))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if least[b[k:k + span]] < order(i):
                mark[k:k + span] = True
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes().decode("utf-8", "ignore")
        if not mark.any() or re.search(r"[^\x20\x09-\x0D]", kept):
            out[i, kept] += 1
    return out


def test_stages_against_brute_force(spark, make, rows, tmp_path):
    from feedloom.llm.quality_rules import with_quality

    extra = [(200 + k, f"Start {k} here. " + " ".join(f"u{k}x{j}" for j in range(40)) + " " + ITEMS[2][1].upper()) for k in range(3)]
    extra += [(300, rows[30][1] + "\nBUY!! NOW!! HERE!!")]
    sf = folder(spark, tmp_path, make(rows + extra, "pipe"))
    docs = spark.read.parquet(sf + "/documents.parquet")
    done = []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(P.STAGES) - 1 or out.columns == P.COLUMNS
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        done.append((name, before, docs))

    _, before, after = done[0]
    judged = with_quality(before, into="_q").filter("_q.kept").selectExpr("doc_id", "_q.cleaned").collect()
    assert Counter(pairs(after)) == Counter((r.doc_id, r.cleaned) for r in judged) and 0 < after.count() < before.count()
    assert all(r.n_chars == len(r.text) for r in after.collect())

    _, before, after = done[1]
    own = pairs(before)
    want = {(i, t) for (i, t), k in zip(own, brute_rows(own)) if k}
    assert Counter(pairs(after)) == Counter(want) and after.count() < before.count()

    _, before, after = done[2]
    assert Counter(pairs(after)) == brute_cut(pairs(before))

    _, before, after = done[3]
    own = pairs(before)
    bad = {k[0] for k in brute_leaks(own, ITEMS) if k[4]}
    assert Counter(pairs(after)) == Counter(x for x in own if x[0] not in bad)
    assert bad == {200}  # the stage before left the leak in its first document

    _, before, after = done[4]
    tokens = defaultdict(int)
    for r in after.collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == {i for i, _ in pairs(before)}
    assert Counter(r.doc_id for r in P.run(spark, sf).select("doc_id").distinct().collect()) == Counter(tokens.keys())


def brute_rows(own):
    """Whether each row is the smallest id of its component."""
    out = []
    counts = brute_near(own, 80, 5)
    keep = {k[0] for k in counts if k[3]}
    gone = {k[0] for k in counts if not k[3]}
    assert not keep & gone
    for i, _ in own:
        out.append(i in keep)
    return out


def colliding():
    """Two different texts with equal CRC-32."""
    import zlib

    seen = {}
    for k in range(10 ** 7):
        t = f"clean text {k} of its own " + " ".join(f"c{k}x{j}" for j in range(6))
        if (c := zlib.crc32(t.encode())) in seen:
            return seen[c], t
        seen[c] = t


def test_rows_that_share_an_id_are_judged_one_by_one(spark, make, tmp_path):
    leak = "Here are the " + ITEMS[2][1]
    one, two = colliding()
    rows = [(None, leak), (None, "a clean text without an id"), (None, one), (None, two), (5, "Some quite different words stand before it: " + ITEMS[2][1]), (5, "a clean text of the same id"),
            (6, "twice the same clean row"), (6, "twice the same clean row")]
    docs = make(rows, "ids")
    sf = folder(spark, tmp_path, docs)
    docs = spark.read.parquet(sf + "/documents.parquet")
    assert Counter(pairs(P.leaks(spark, docs, sf))) == Counter(r for r in rows if ITEMS[2][1] not in r[1])
    assert Counter(pairs(P.near(spark, docs, sf))) == Counter(set(rows))
    assert Counter(pairs(P.substring(spark, docs, sf))) == brute_cut(rows)


def test_the_stage_of_leaks_stores_its_index_as_values(spark, make, rows, tmp_path):
    """The stored postings of a segment are one value, no array of terms that a reader holds for all segments of a task."""
    from feedloom.session import shared_dir

    sf = folder(spark, tmp_path, make(rows, "index"))
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-postings-*"))
    assert P.leaks(spark, spark.read.parquet(sf + "/documents.parquet"), sf).count() > 0
    path, = set(Path(shared_dir(spark).removeprefix("file:")).glob("pipeline-postings-*")) - before
    assert dict(spark.read.parquet(str(path)).dtypes) == {"segment": "bigint", "doc_ids": "array<string>", "doc_words": "array<bigint>",
                                                          "doc_starts": "array<bigint>", "postings": "binary"}


def test_the_stage_of_leaks_exchanges_no_text(spark, make, rows, tmp_path):
    """Which documents go is known, and small, when the join with the texts is planned."""
    sf = folder(spark, tmp_path, make(rows + [(400, "It is " + ITEMS[2][1])], "exchange"))
    out = P.leaks(spark, spark.read.parquet(sf + "/documents.parquet"), sf)
    assert out.filter("doc_id = 400").count() == 0 and out.filter("doc_id = 30").count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_empty_documents(spark, empty, tmp_path):
    sf = folder(spark, tmp_path, empty)
    assert P.run(spark, sf).collect() == []


def test_the_rest_works_without_the_subpackage(tmp_path):
    """The entry imports, and names the other queries, where the corpus files are deleted."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'skill_stats' in q and 'pipeline' not in q; "
            "assert not any(k.startswith('op') for k in q); assert set(s) <= set(q); print(len(q))")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_the_entry_names_all_eleven():
    import __spark_entry__ as E

    names = list(E.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_an_import_error_inside_the_subpackage_is_not_swallowed(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "r" / "feedloom" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode and "no_such_module_at_all" in done.stderr

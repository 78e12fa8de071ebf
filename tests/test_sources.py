"""File sources (S6-S8), the CSV sink (K1) and tables stored by id block."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F, types as T

from feedloom.schemas import CORRECTIONS


def test_scope_manifests_and_skill_lists(spark, tmp_path):
    from feedloom.sources.registry import read_scopes, read_skill_lists

    d = tmp_path / "scopes"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"feedback_scope": "team-a", "feedback_server_url": "http://x:1",
                                          "reportable_skills": ["s1", "s2"]}, indent=2))
    (d / "b.json").write_text(json.dumps({"feedback_scope": "team-b", "feedback_server_url": "http://y:1",
                                          "reportable_skills": ["s2"]}))
    got = sorted((r["feedback_scope"], tuple(r["reportable_skills"])) for r in read_scopes(spark, str(d)).collect())
    assert got == [("team-a", ("s1", "s2")), ("team-b", ("s2",))]
    k = tmp_path / "skills"
    k.mkdir()
    (k / "1.json").write_text('["a", "b"]')
    (k / "2.json").write_text('{"skills": ["c"]}')
    (k / "3.json").write_text('{"other": 1}')
    (k / "4.json").write_text('["a", 1]')
    (k / "5.json").write_text("[]")
    lists = {r["file_path"].rsplit("/", 1)[-1]: r["skills"] for r in read_skill_lists(spark, str(k)).collect()}
    assert lists == {"1.json": ["a", "b"], "2.json": ["c"], "3.json": None, "4.json": None, "5.json": []}


def test_skill_catalog(spark, tmp_path):
    from feedloom.sources.registry import read_skill_catalog

    for name, text in {"one": "---\nname: brainstorming \ndescription: x\n---\n",
                       "two": "no name here\n", "three": "---\nname: feedback-rules-team\n---\n",
                       "four": "intro\nname:   tdd\nname: second\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "SKILL.md").write_text(text)
    (tmp_path / "four" / "README.md").write_text("name: not-a-skill\n")
    got = sorted((r["path"].rsplit("/", 2)[-2], r["name"]) for r in read_skill_catalog(spark, str(tmp_path)).collect())
    assert got == [("four", "tdd"), ("one", "brainstorming")]


def test_csv_sink_text(spark, tmp_path):
    from feedloom.sources.sinks import write_csv

    rows = [(2, "s,1", "/r", ["a", "b"], 'say "hi"', "line\nbreak", 1.0, True, dt.datetime(2026, 6, 11, 18, 2)),
            (1, "s", "/r", [], "", "fix", 0.25, False, dt.datetime(2026, 6, 11, 18, 2, 0, 123000)),
            (3, "s", "/r", ["x"], "cr\rhere", " pad ", 1e-7, False, dt.datetime(2026, 6, 12))]
    write_csv(spark.createDataFrame(rows, CORRECTIONS).repartition(3), str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == (
        "id,skill_name,working_directory,tech_stack,ai_output,user_correction_input,classification_confidence,"
        "needs_batch_review,created_at\n"
        "1,s,/r,,,fix,0.25,false,2026-06-11T18:02:00.123Z\n"
        '2,"s,1",/r,a;b,"say ""hi""","line\nbreak",1,true,2026-06-11T18:02:00.000Z\n'
        '3,s,/r,x,"cr\rhere", pad ,1e-7,false,2026-06-12T00:00:00.000Z\n')
    write_csv(spark.createDataFrame(rows, CORRECTIONS), str(tmp_path / "range"), "2026-06-12", "2026-06-12")
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "range").glob("part-*")))
    assert text.count("\n") == 2 and text.endswith("2026-06-12T00:00:00.000Z\n")


def test_tables_helpers(spark):
    from feedloom.sources.tables import count_in_id_range, decode_stored_rows, in_id_range

    df = spark.createDataFrame([(1, '["a","b"]', 1), (5, "[]", 0)], "id long, tech_stack_json string, "
                               "needs_batch_review int")
    dec = decode_stored_rows(df).orderBy("id").collect()
    assert dec[0]["tech_stack"] == ["a", "b"] and dec[0]["needs_batch_review"] is True
    assert dec[1]["tech_stack"] == [] and dec[1]["needs_batch_review"] is False
    assert in_id_range(df, 2, 5).count() == 1
    assert count_in_id_range(df, 1, 5).first()["count"] == 2


def test_append_and_endpoint_base(spark, tmp_path):
    from feedloom.functions.scopes import endpoint_base
    from feedloom.sources.sinks import append

    path = str(tmp_path / "events")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, skill_name string")
    append(df, path)
    append(df, path)  # no deduplication: the same event twice is two rows
    assert spark.read.parquet(path).count() == 4
    got = [r[0] for r in spark.createDataFrame([("http://x:1///",), ("http://x:1",)], "u string")
           .select(endpoint_base(F.col("u"))).collect()]
    assert got == ["http://x:1", "http://x:1"]


def test_assigned_ids_unique_when_written_whole(spark, tmp_path):
    """W3 regression: numbered rows written with every column (and shuffled again) keep
    unique, dense ids. The range layout is evaluated once (checkpointed), so the
    per-partition counts and the rows cannot see different partition bounds."""
    from pyspark.sql import functions as F

    from feedloom.sources.fixtures import fx_corrections

    path = str(tmp_path / "cor")
    fx_corrections(spark, "/root/testdata/sf0.1").repartition(7).write.parquet(path)
    got = spark.read.parquet(path).agg(F.count("id").alias("n"), F.countDistinct("id").alias("d"),
                                       F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    assert (got["d"], got["lo"], got["hi"]) == (got["n"], 1, got["n"])


def _stored(spark, base, n=20, mr_rows=()):
    """Corrections 1..n and MRs (id, type, status, start, end), stored by id block."""
    from feedloom.schemas import MERGE_REQUESTS
    from feedloom.sources import sinks

    t = dt.datetime(2026, 6, 11)
    cor = spark.createDataFrame([(i, "s", "/r", ["ts"], f"secret {i}", "u", 0.9, False, t) for i in range(1, n + 1)], CORRECTIONS)
    mrs = spark.createDataFrame([(i, f"u{i}", "x", f"h{i}", typ, s, e, status, t, t, None) for i, typ, status, s, e in mr_rows], MERGE_REQUESTS)
    sinks.append_blocks(cor, base, "corrections")
    sinks.append_blocks(mrs, base, "merge_requests")


def _left(spark, base):
    from feedloom.sources import sinks

    return sorted(r.id for r in sinks.read_blocks(spark, base, "corrections", CORRECTIONS).collect())


def _audit(spark, base):
    from feedloom.schemas import PURGE_AUDIT
    from feedloom.sources import sinks

    return sorted((r.id, r.merge_request_id, r.deleted_count) for r in sinks.read_stored(spark, base, "purge_audit", PURGE_AUDIT).collect())


MRS = [(1, "major", "merged", 1, 4), (2, "major", "merged", 3, 6), (3, "minor", "merged", 7, 9), (4, "major", "open", 1, 20), (5, "major", "merged", 30, 40)]


def test_stored_purge_changes_all_three_tables(spark, tmp_path):
    from feedloom.operators.purge import purge_stored
    from feedloom.schemas import MERGE_REQUESTS
    from feedloom.sources import sinks

    base = str(tmp_path / "store")
    _stored(spark, base, 10, MRS)
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,), (9,)], "id long")
    refused = purge_stored(spark, base, dt.datetime(2026, 6, 20), asked)
    assert sorted(map(tuple, refused.collect())) == [(3, "not_major"), (4, "not_merged"), (9, "not_found")]
    assert _left(spark, base) == [7, 8, 9, 10]
    assert _audit(spark, base) == [(1, 1, 4), (2, 2, 2), (3, 5, 0)]  # the overlap counts for the earlier MR only
    marked = {r.id: r.purged_at for r in sinks.read_blocks(spark, base, "merge_requests", MERGE_REQUESTS).collect()}
    assert sorted(i for i in marked if marked[i]) == [1, 2, 5]
    assert sinks.high_water_mark(spark, base, "corrections").first()[0] == 10  # ids never come back
    purge_stored(spark, base, dt.datetime(2026, 6, 21))  # nothing is eligible any more
    assert len(_audit(spark, base)) == 3 and _left(spark, base) == [7, 8, 9, 10]


def test_stored_purge_replaces_only_the_blocks_it_reaches(spark, tmp_path, monkeypatch):
    from feedloom.operators.purge import purge_stored
    from feedloom.sources import sinks

    monkeypatch.setattr(sinks, "BLOCK_IDS", 4)
    base = tmp_path / "store"
    _stored(spark, str(base), 20, [(1, "major", "merged", 5, 6), (2, "major", "merged", 11, (1 << 53) - 1)])
    files = lambda: {p.parent.name: {q.name for q in p.parent.glob("part-*")} for p in base.glob("corrections/_blk=*/part-*")}
    before = files()
    purge_stored(spark, str(base), dt.datetime(2026, 6, 20), spark.createDataFrame([(1,)], "id long"))
    after = files()
    assert _left(spark, str(base)) == [1, 2, 3, 4, *range(7, 21)]
    assert {b for b in before if before[b] != after[b]} == {"_blk=1"}
    purge_stored(spark, str(base), dt.datetime(2026, 6, 21))
    assert _left(spark, str(base)) == [1, 2, 3, 4, 7, 8, 9, 10] and files()["_blk=0"] == before["_blk=0"]
    assert _audit(spark, str(base)) == [(1, 1, 2), (2, 2, 10)]


def test_stored_purge_that_empties_every_block_leaves_no_text(spark, tmp_path, monkeypatch):
    from feedloom.operators.purge import purge_stored
    from feedloom.sources import sinks

    monkeypatch.setattr(sinks, "BLOCK_IDS", 4)
    base = tmp_path / "store"
    _stored(spark, str(base), 8, [(7, "major", "merged", 1, 100)])
    purge_stored(spark, str(base), dt.datetime(2026, 6, 20))
    assert _left(spark, str(base)) == [] and _audit(spark, str(base)) == [(1, 7, 8)]
    assert not any(b"secret" in p.read_bytes() for p in base.rglob("*") if p.is_file())
    assert sinks.high_water_mark(spark, str(base), "corrections").first()[0] == 8


@pytest.mark.parametrize("stop", ["corrections", "merge_requests"])
def test_stored_purge_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, stop):
    from feedloom.operators.purge import purge_stored
    from feedloom.sources import sinks

    base = str(tmp_path / "store")
    _stored(spark, base, 10, MRS)
    real = sinks.replace_blocks

    def broken(rows, blocks, base, table):
        if table == stop:
            raise RuntimeError("lost")
        real(rows, blocks, base, table)

    monkeypatch.setattr(sinks, "replace_blocks", broken)
    with pytest.raises(RuntimeError):
        purge_stored(spark, base, dt.datetime(2026, 6, 20), spark.createDataFrame([(2,)], "id long"))
    monkeypatch.setattr(sinks, "replace_blocks", real)
    purge_stored(spark, base, dt.datetime(2026, 6, 25))  # takes up MR 2 with its time, then MRs 1 and 5
    assert _left(spark, base) == [7, 8, 9, 10]
    assert _audit(spark, base) == [(1, 2, 4), (2, 1, 2), (3, 5, 0)]


def test_only_a_missing_path_counts_as_an_empty_table(spark, tmp_path):
    from feedloom.sources import sinks

    schema = T.StructType([T.StructField("id", T.LongType())])
    assert sinks.read_stored(spark, str(tmp_path), "none", schema).count() == 0
    assert sinks.high_water_mark(spark, str(tmp_path), "none").first()[0] == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet file")
    with pytest.raises(Exception):
        sinks.read_stored(spark, str(tmp_path), "bad", schema).collect()


def test_fan_out_writes_each_row_once_and_counts(spark, tmp_path):
    from feedloom.operators.checks import errors_text
    from feedloom.sources.ingest import checked_mr_posts, checked_status_updates, fan_out, read_outcome

    good = {"mr_url": "https://h/1", "title": "[skills-feedback][major][feedback:1-2] x", "head_commit_hash": "h", "iteration_type": "major",
            "feedback_id_start": 1, "feedback_id_end": 2, "status": "open", "opened_at": "2026-06-11T18:02Z"}
    cases = [good, good | {"title": "x"}, good | {"title": "[skills-feedback][minor][feedback:1-2] x"}, good | {"feedback_id_start": 3}, good | {"status": "merged"}, [1]]
    raw = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)], "arrival long, payload string")
    path = str(tmp_path / "mr")
    assert fan_out(checked_mr_posts(raw), path) == {"valid": 1, "rejected": 5}
    assert [r.arrival for r in read_outcome(spark, path, "valid").collect()] == [0]
    bad = read_outcome(spark, path, "rejected").select("arrival", "payload", errors_text(F.col("errors")).alias("e")).collect()
    assert {r.arrival: r.e for r in bad} == {1: "title:invalid_title", 2: "title:title_payload_mismatch", 3: "feedback_id_end:range_order",
                                             4: "merged_at:merged_at_status", 5: "$:type"}
    assert all(json.loads(r.payload) == cases[r.arrival] for r in bad)  # can be replayed
    known = spark.createDataFrame([(7,), (7,)], "id long")
    ups = spark.createDataFrame([(0, 7, '{"status":"open"}'), (1, 8, '{"status":"open"}'), (2, None, '{"status":"open"}'), (3, -1, '{"status":"x"}')],
                                "arrival long, id long, payload string")
    assert fan_out(checked_status_updates(ups, known), str(tmp_path / "st")) == {"valid": 1, "rejected": 3}


def test_day_copy_prunes_folders_and_is_purged(spark, tmp_path):
    from feedloom.operators.export import in_date_range
    from feedloom.operators.purge import purge_stored
    from feedloom.sources import sinks

    base = tmp_path / "store"
    _stored(spark, str(base), 12, [(1, "major", "merged", 4, 6), (2, "major", "merged", 11, 40)])
    rows = sinks.read_blocks(spark, str(base), "corrections", CORRECTIONS)
    dated = rows.withColumn("created_at", F.expr("created_at + make_dt_interval(cast(id div 4 as int))"))  # days 0: 1-3, 1: 4-7, 2: 8-11, 3: 12
    sinks.replace_blocks(dated, rows.select(F.lit(0).cast("long").alias("_blk")).distinct(), str(base), "corrections")
    sinks.append_days(sinks.read_blocks(spark, str(base), "corrections", CORRECTIONS), str(base), "corrections_by_day")
    days = lambda: sinks.read_days(spark, str(base), "corrections_by_day", CORRECTIONS)
    text = in_date_range(days(), "2026-06-12", "2026-06-12").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_day" in text
    assert sorted(r.id for r in in_date_range(days(), "2026-06-12", "2026-06-12").collect()) == [4, 5, 6, 7]
    files = lambda: {p.parent.name: {q.name for q in p.parent.glob("part-*")} for p in (base / "corrections_by_day").glob("*/part-*")}
    before = files()
    purge_stored(spark, str(base), dt.datetime(2026, 6, 20))
    assert sorted(r.id for r in days().collect()) == [1, 2, 3, 7, 8, 9, 10] == _left(spark, str(base))
    assert {d for d in before if files()[d] == before[d]} == {"created_day=2026-06-11"}


def test_every_constraint_of_the_schema_can_fail(spark):
    from feedloom.operators.constraints import CHECKS, SCHEMAS, UNIQUE, violations
    from feedloom.sources.fixtures import fx_broken

    got = {(r.table_name, r.check) for r in violations(fx_broken(spark, "/root/testdata/sf0.001")).select("table_name", "check").distinct().collect()}
    want = {(t, f"not_null:{f.name}") for t, s in SCHEMAS.items() for f in s.fields[1:] if not f.nullable}
    want |= {(t, f"check:{c}") for t, cs in CHECKS.items() for c in cs} | {(t, f"unique:{k}") for t, ks in UNIQUE.items() for k in ks}
    assert got == want | {("purge_audit", "references:merge_request_id")}

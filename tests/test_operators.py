"""Operators on small frames: golden cases of the service's tests and the
invariants of SURVEY section 5, with brute-force checks for the range joins."""

import datetime as dt
import json
import random

import pytest

from pyspark.sql import functions as F

from feedloom.schemas import CORRECTIONS, INVOCATIONS, MERGE_REQUESTS

T0 = dt.datetime(2026, 6, 11, 18, 2)


def corrections(spark, rows):
    """rows: (id, skill, created_at[, confidence])"""
    data = [(i, s, "/repo", ["typescript", "fastify"], "out", "fix", c, False, t)
            for (i, s, t, *rest) in rows for c in [rest[0] if rest else 0.9]]
    return spark.createDataFrame(data, CORRECTIONS)


def invocations(spark, rows):
    data = [(i, s, "/repo", ["ts"], T0, None, st) for (i, s, st) in rows]
    return spark.createDataFrame(data, INVOCATIONS)


def mr(i, url, typ, s, e, status, merged=None, purged=None, opened=T0):
    return (i, url, f"[skills-feedback][{typ}][feedback:{s}-{e}] x", f"h{i}", typ, s, e, status, opened, merged, purged)


def test_leaderboard_golden(spark):
    from feedloom.operators.stats import skill_stats, skill_stats_join_form, totals

    inv = invocations(spark, [(1, "superpowers:brainstorming", "success"), (2, "superpowers:brainstorming", "failed"),
                              (3, "superpowers:brainstorming", "unknown"),
                              (4, "superpowers:test-driven-development", "success"),
                              (5, "superpowers:receiving-code-review", "success")])
    cor = corrections(spark, [(1, "superpowers:brainstorming", T0), (2, "superpowers:test-driven-development", T0),
                              (3, "superpowers:test-driven-development", T0),
                              (4, "superpowers:verification-before-completion", T0)])
    got = [tuple(r) for r in skill_stats(inv, cor).collect()]
    assert got == [("superpowers:test-driven-development", 1, 2, 2.0),
                   ("superpowers:brainstorming", 3, 1, 1 / 3),
                   ("superpowers:verification-before-completion", 0, 1, 0.0),
                   ("superpowers:receiving-code-review", 1, 0, 0.0)]
    assert [tuple(r) for r in skill_stats_join_form(inv, cor).collect()] == got
    assert tuple(totals(inv, cor).first()) == (5, 4)
    empty_i, empty_c = inv.limit(0), cor.limit(0)
    assert tuple(totals(empty_i, empty_c).first()) == (0, 0)


def test_validation_golden(spark):
    from feedloom.operators.checks import errors_text
    from feedloom.sources.ingest import validate_corrections

    base = {"skill_name": "s", "working_directory": "/r", "tech_stack": ["ts"], "ai_output": "a",
            "user_correction_input": "u", "classification_confidence": 0.9, "needs_batch_review": False,
            "created_at": "2026-06-11T18:02:00.000Z"}
    cases = [
        {},  # valid
        {"skill_name": "feedback-rules"}, {"skill_name": "feedback-rules-team"},
        {"classification_confidence": 1.5}, {"classification_confidence": "0.9"}, {"skill_name": 123},
        {"tech_stack": ["ts", 1]}, {"tech_stack": "ts"}, {"tech_stack": []}, {"tech_stack": [""]},
        {"created_at": "2026-06-11T18:02:00+08:00"}, {"needs_batch_review": 0}, {"extra": 1},
        {"classification_confidence": 1}, {"created_at": "2026-02-30T00:00:00Z"},
    ]
    rows = [(i, json.dumps({**base, **c})) for i, c in enumerate(cases)]
    rows.append((len(rows), json.dumps({k: v for k, v in base.items() if k != "ai_output"})))
    rows.append((len(rows), "not json"))
    raw = spark.createDataFrame(rows, "arrival long, payload string")
    valid, rejected = validate_corrections(raw)
    ok = sorted(r[0] for r in valid.select("arrival").collect())
    assert ok == [0, 8, 12, 13]
    errs = dict(rejected.select("arrival", errors_text(F.col("errors"))).collect())
    assert errs[1] == "skill_name:reserved" and errs[2] == "skill_name:reserved"
    assert errs[3] == "classification_confidence:range"
    assert errs[4] == "classification_confidence:type"
    assert errs[5] == "skill_name:type"
    assert errs[6] == "tech_stack:type"  # mixed array shows as ARRAY<VARIANT>
    assert errs[7] == "tech_stack:type"
    assert errs[9] == "tech_stack:element"
    assert errs[10] == "created_at:format"
    assert errs[11] == "needs_batch_review:type"
    assert errs[14] == "created_at:format"
    assert errs[15] == "ai_output:missing"
    assert errs[16] == "$:type"


def test_mr_post_validation(spark):
    from feedloom.operators.checks import errors_text
    from feedloom.sources.ingest import validate_mr_posts

    base = {"mr_url": "https://git.example/mr/1", "title": "[skills-feedback][minor][feedback:1-2] x",
            "head_commit_hash": "abc", "iteration_type": "minor", "feedback_id_start": 1, "feedback_id_end": 2,
            "status": "open", "opened_at": "2026-06-11T18:02:00.000Z"}
    cases = [{}, {"mr_url": "javascript:alert(1)"}, {"status": "merged"},
             {"title": "[skills-feedback][major][feedback:1-3] x"}, {"feedback_id_start": 3},
             {"feedback_id_start": 0}, {"status": "open", "merged_at": "2026-06-12T00:00:00Z"},
             {"status": "merged", "merged_at": "2026-06-12T00:00:00Z"}, {"title": "skill updates"},
             {"feedback_id_start": 1.0}, {"feedback_id_start": 1.5}]
    raw = spark.createDataFrame([(i, json.dumps({**base, **c})) for i, c in enumerate(cases)],
                                "arrival long, payload string")
    good, bad = validate_mr_posts(raw)
    assert sorted(r[0] for r in good.select("arrival").collect()) == [0, 7, 9]
    errs = dict(bad.select("arrival", errors_text(F.col("errors"))).collect())
    assert errs[1] == "mr_url:url"
    assert errs[2] == "merged_at:merged_at_status"
    assert errs[3] == "title:title_payload_mismatch"
    assert errs[4] == "feedback_id_end:range_order"
    assert errs[5] == "feedback_id_start:range"
    assert errs[6] == "merged_at:merged_at_status"
    assert errs[8] == "title:invalid_title"
    assert errs[10] == "feedback_id_start:type"


def test_date_range_and_export(spark, tmp_path):
    from feedloom.operators.export import export_lines, in_date_range, normalize_bounds
    from feedloom.sources.sinks import write_csv

    cor = corrections(spark, [(1, "s", T0), (2, "s", dt.datetime(2026, 6, 11, 23, 59, 59, 999500)),
                              (3, "s", dt.datetime(2026, 6, 12)), (4, "s", dt.datetime(2026, 6, 10, 23, 59, 59))])
    assert sorted(r[0] for r in in_date_range(cor, "2026-06-11", "2026-06-11").select("id").collect()) == [1, 2]
    assert in_date_range(cor, "2026-06-12", "2026-06-11").count() == 0
    assert sorted(r[0] for r in in_date_range(cor, "2026-06-11T18:02:00Z", "2026-06-12T00:00:00.000Z")
                  .select("id").collect()) == [1, 2, 3]
    for bad in [("", "2026-06-11"), ("2026-06-11", "tomorrow")]:
        try:
            normalize_bounds(*bad)
            raise AssertionError("should raise")
        except ValueError:
            pass
    assert normalize_bounds("2026-06-11T10:00Z", "2026-06-11T10:00:00.1234567Z") == (
        dt.datetime(2026, 6, 11, 10), dt.datetime(2026, 6, 11, 10, 0, 0, 123456), True)
    assert normalize_bounds("2026-06-11T10:00:00.1234567Z", "2026-06-12")[0] == dt.datetime(2026, 6, 11, 10, 0, 0, 123457)
    sent = cor.withColumn("created_at_sent", F.when(F.col("id") == 1, "2026-06-11T18:02Z"))
    assert sorted(r["line"].rsplit(",", 1)[1] for r in export_lines(sent, "2026-06-11", "2026-06-11").collect()) == [
        "2026-06-11T18:02Z", "2026-06-11T23:59:59.999500Z"]
    line = export_lines(cor, "2026-06-11", "2026-06-11").filter("id = 1").first()["line"]
    assert line == "1,s,/repo,typescript;fastify,out,fix,0.9,false,2026-06-11T18:02:00.000Z"
    out = str(tmp_path / "csv")
    write_csv(cor.limit(0), out)
    text = "".join(open(p).read() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text.strip() == ("id,skill_name,working_directory,tech_stack,ai_output,user_correction_input,"
                            "classification_confidence,needs_batch_review,created_at")


def brute_counts(ranges, ids):
    return {k: sum(1 for i in ids if s <= i <= e) for k, s, e in ranges}


def test_range_counts_match_brute_force(spark, monkeypatch):
    from feedloom.operators import ranges as ranges_module
    from feedloom.operators.ranges import count_in_ranges

    rnd = random.Random(7)
    ids = sorted(rnd.sample(range(1, 5000), 1500))
    ranges = []
    for k in range(300):
        s = rnd.randint(1, 5200)
        w = rnd.choice([0, 1, 3, 7, 20, 64, 300, 2000, 5000])
        ranges.append((k, s, s + w))
    ranges.append((300, 10, 5))  # empty range
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    rdf = spark.createDataFrame(ranges, "id long, feedback_id_start long, feedback_id_end long")
    assert dict(count_in_ranges(rdf, rows).collect()) == brute_counts(ranges, ids)
    # tiny blocks and groups, so both running sums matter
    monkeypatch.setattr(ranges_module, "BLOCK_BITS", 3)
    monkeypatch.setattr(ranges_module, "GROUP_BITS", 4)
    assert dict(count_in_ranges(rdf, rows).collect()) == brute_counts(ranges, ids)


def test_purge_golden_and_invariants(spark):
    from feedloom.operators.export import in_date_range
    from feedloom.operators.purge import purge

    cor = corrections(spark, [(1, "s", T0), (2, "s", T0)])
    mrs = spark.createDataFrame([mr(1, "u1", "major", 1, 2, "merged", T0)], MERGE_REQUESTS)
    r = purge(cor, mrs, dt.datetime(2026, 6, 20))
    assert [tuple(x)[1:5] for x in r.audit.collect()] == [(1, 1, 2, 2)]
    assert in_date_range(r.survivors, "2026-06-01", "2026-06-30").count() == 0
    again = purge(r.survivors, r.marked, dt.datetime(2026, 6, 21), requests=spark.createDataFrame([(1,)], "id long"))
    assert [tuple(x) for x in again.refused.collect()] == [(1, "already_purged")]
    refused = purge(cor, spark.createDataFrame([mr(1, "u1", "major", 1, 2, "open"),
                                                mr(2, "u2", "minor", 1, 2, "merged", T0)], MERGE_REQUESTS),
                    dt.datetime(2026, 6, 20), requests=spark.createDataFrame([(1,), (2,), (9,)], "id long"))
    assert sorted(tuple(x) for x in refused.refused.collect()) == [(1, "not_merged"), (2, "not_major"),
                                                                    (9, "not_found")]
    assert refused.survivors.count() == 2


def test_purge_overlaps_brute_force(spark, monkeypatch):
    from feedloom.operators import ranges as ranges_module
    from feedloom.operators.purge import purge
    from feedloom.operators.ranges import first_owner

    rnd = random.Random(3)
    ids = sorted(rnd.sample(range(1, 3000), 900))
    cor = corrections(spark, [(i, "s", T0) for i in ids])
    rows = []
    for k in range(1, 60):
        s = rnd.randint(1, 3000)
        e = s + rnd.choice([0, 5, 40, 400, 1500])
        typ = "major" if k % 3 else "minor"
        rows.append(mr(k, f"u{k}", typ, s, e, rnd.choice(["merged", "merged", "open"]), T0))
    mrs = spark.createDataFrame(rows, MERGE_REQUESTS)
    r = purge(cor, mrs, dt.datetime(2026, 7, 1))
    elig = [(x[0], x[5], x[6]) for x in rows if x[4] == "major" and x[7] == "merged"]
    owner = {}
    for i in ids:
        cover = [k for k, s, e in elig if s <= i <= e]
        if cover:
            owner[i] = min(cover)
    surv = sorted(x[0] for x in r.survivors.select("id").collect())
    assert surv == [i for i in ids if i not in owner]
    audit = {x["merge_request_id"]: x["deleted_count"] for x in r.audit.collect()}
    assert set(audit) == {k for k, _, _ in elig}
    for k, _, _ in elig:
        assert audit[k] == sum(1 for v in owner.values() if v == k)
    assert sum(audit.values()) + len(surv) == len(ids)  # deleted + surviving = before
    marked = {x[0]: x[1] for x in r.marked.select("id", "purged_at").collect()}
    assert all((marked[k] is not None) == (k in audit) for k in marked)
    # small blocks, groups and chunks of nodes
    for name, bits in (("BLOCK_BITS", 3), ("GROUP_BITS", 3), ("NODE_BITS", 2)):
        monkeypatch.setattr(ranges_module, name, bits)
    small = first_owner(cor, mrs.filter("iteration_type = 'major' AND status = 'merged'"), F.col("id"))
    got = {x[0]: x[1] for x in small.select("id", "owner").collect()}
    assert {i: o for i, o in got.items() if o is not None} == owner


@pytest.mark.parametrize("bits", [2, 5, 12])
def test_ranges_in_hot_blocks_brute_force(spark, bits, monkeypatch):
    """Many short, overlapping ranges packed into a few blocks; wide ones; counts per owner from ranks alone."""
    from collections import Counter

    from feedloom.operators import ranges as ranges_module
    from feedloom.operators.ranges import count_by_owner, count_in_ranges, first_owner, owner_steps

    monkeypatch.setattr(ranges_module, "BLOCK_BITS", bits)
    monkeypatch.setattr(ranges_module, "NODE_BITS", bits)
    rnd = random.Random(bits)
    ids = sorted(rnd.sample(range(0, 300), 220))
    ranges = []
    for k in range(1, 400):
        s = rnd.randint(0, 300)
        ranges.append((k, s, s + rnd.choice([0, 1, 2, 5, 9, 17, 33, 90])))
    ranges += [(400, 290, (1 << 53) - 1), (401, 295, (1 << 53) - 1), (402, 9, 3)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    rdf = spark.createDataFrame(ranges, "id long, feedback_id_start long, feedback_id_end long")
    assert dict(count_in_ranges(rdf, rows).collect()) == brute_counts(ranges, ids)
    assert count_in_ranges(rdf.limit(0), rows).collect() == [] and not any(r[1] for r in count_in_ranges(rdf, rows.limit(0)).collect())
    owners = {x[0]: x[1] for x in first_owner(rows, rdf, F.col("id")).select("id", "owner").collect()}
    expect = {}
    for i in ids:
        cover = [k for k, s, e in ranges if s <= i <= e]
        expect[i] = min(cover) if cover else None
    assert owners == expect
    counts = {r["_own"]: r["n"] for r in count_by_owner(rows, owner_steps(rdf, F.col("id"))).collect() if r["n"]}
    assert counts == Counter(o for o in expect.values() if o is not None)
    assert {r["owner"] for r in first_owner(rows, rdf.limit(0), F.col("id")).collect()} == {None}


def test_upsert_update_branch(spark):
    from feedloom.operators.upgrades import apply_status_updates, latest, upsert

    old = spark.createDataFrame([mr(5, "u1", "major", 1, 2, "merged", T0, purged=T0)], MERGE_REQUESTS)
    posts = spark.createDataFrame([
        (10, "u1", "[skills-feedback][major][feedback:1-2] x", "h2", "major", 1, 2, "merged", T0, T0),
        (11, "u1", "[skills-feedback][major][feedback:1-2] y", "h3", "major", 1, 2, "open", T0, None),
        (12, "u2", "[skills-feedback][minor][feedback:3-4] z", "h4", "minor", 3, 4, "open", T0, None),
        (13, "u3", "[skills-feedback][minor][feedback:5-6] z", "h5", "minor", 5, 6, "open", T0, None),
    ], "arrival long, mr_url string, title string, head_commit_hash string, iteration_type string, "
       "feedback_id_start long, feedback_id_end long, status string, opened_at timestamp_ntz, merged_at timestamp_ntz")
    new = {r["mr_url"]: r for r in upsert(old, posts, high_water_mark=7).collect()}
    assert new["u1"]["id"] == 5 and new["u1"]["purged_at"] == T0  # stays purged
    assert new["u1"]["merged_at"] is None and new["u1"]["status"] == "open" and new["u1"]["head_commit_hash"] == "h3"
    assert (new["u2"]["id"], new["u3"]["id"]) == (8, 9)  # after the high-water mark, arrival order
    table = upsert(old, posts, 7)
    updates = spark.createDataFrame([(1, 8, "merged", T0), (2, 8, "closed", None), (3, 99, "merged", T0)],
                                    "arrival long, id long, status string, merged_at timestamp_ntz")
    t2, errors = apply_status_updates(table, updates)
    row = t2.filter("id = 8").first()
    assert (row["status"], row["merged_at"]) == ("closed", None)
    assert [tuple(e) for e in errors.collect()] == [(3, 99, "not_found")]
    later = spark.createDataFrame([mr(1, "a", "minor", 1, 1, "open", opened=T0),
                                   mr(2, "b", "minor", 1, 1, "open", opened=T0),
                                   mr(3, "c", "minor", 1, 1, "open", opened=T0 - dt.timedelta(days=1))],
                                  MERGE_REQUESTS)
    assert latest(later).first()["id"] == 2
    assert latest(later.limit(0)).count() == 0


def test_assign_ids_dense(spark):
    from feedloom.operators.ids import assign_ids

    rnd = random.Random(1)
    keys = rnd.sample(range(10 ** 9), 5000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(13)
    expect = {k: 42 + i for i, k in enumerate(sorted(keys))}
    for rows_per_part in (1 << 18, 400, 3):
        got = assign_ids(df, ["k"], start_after=41, rows_per_part=rows_per_part)
        assert {r["k"]: r["id"] for r in got.select("k", "id").collect()} == expect
    assert assign_ids(df.limit(0), ["k"]).collect() == []
    text = got._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" not in text  # no sampled layout: the parts follow from the keys


def test_assign_ids_on_several_columns_of_any_type(spark):
    from feedloom.operators.ids import assign_ids

    rnd = random.Random(2)
    rows = [(dt.datetime(2024, 1, 1 + rnd.randrange(2)), f"url {rnd.randrange(10 ** 9)}") for _ in range(800)] + [(None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "at timestamp_ntz, url string").repartition(5)
    got = {(r["at"], r["url"]): r["id"] for r in assign_ids(df, ["at", "url"], rows_per_part=50).collect()}
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or dt.datetime.min, r[1]))
    assert [got[r] for r in want] == list(range(1, len(rows) + 1))


def test_turn_pairs_with_gaps(spark):
    from feedloom.operators.routing import turn_pairs

    rnd = random.Random(5)
    rows = []
    for conv in range(6):
        turn = 0
        for _ in range(rnd.randint(1, 30)):
            turn += rnd.choice([1, 1, 2, 5])
            rows.append((conv, turn, rnd.choice(["user", "assistant", "system"]), f"t{conv}-{turn}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expect = set()
    by = {}
    for r in sorted(rows):
        by.setdefault(r[0], []).append(r)
    for conv, rs in by.items():
        for a, b in zip(rs, rs[1:]):
            if b[2] == "user" and a[2] == "assistant":
                expect.add((conv, b[1], a[3], b[3]))
    got = {tuple(r) for r in turn_pairs(df, bucket_turns=3).collect()}
    assert got == expect


def test_iteration_memberships(spark):
    from feedloom.operators.iterations import summary

    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 23), dt.datetime(2024, 1, 30)]
    cor = corrections(spark, [(i + 1, f"s{i % 2}", d) for i, d in enumerate(days)])
    got = {(r["iteration_slot"], r["iteration_type"]): (r["feedback_count"], r["skills"])
           for r in summary(cor, dt.date(2024, 1, 1), 7, 4).collect()}
    # slot 4 (days 21-27) is a major only; the major covers slots 1..4
    assert got == {(1, "minor"): (1, "s0"), (2, "minor"): (1, "s1"), (4, "major"): (3, "s0,s1"),
                   (5, "minor"): (1, "s1"), (8, "major"): (1, "s1")}


def test_scope_routing(spark):
    from feedloom.operators.routing import route, scope_conflicts

    scopes = spark.createDataFrame([("a", "http://x", ["k1", "k2"]), ("b", "http://y", ["k2", "k3", "k3"])],
                                   "feedback_scope string, feedback_server_url string, reportable_skills array<string>")
    cor = corrections(spark, [(1, "k1", T0), (2, "k2", T0), (3, "k3", T0), (4, "k9", T0)])
    assert sorted(tuple(r) for r in route(cor, scopes).select("id", "feedback_scope").collect()) == [(1, "a"), (3, "b")]
    assert [r["skill_name"] for r in scope_conflicts(scopes).collect()] == ["k2"]


def test_upgrade_decisions_and_last_seen(spark):
    from feedloom.operators.scopes import decisions, record_last_seen

    seen = spark.createDataFrame([("s1", "h1"), ("s2", None), ("s3", "old")], "scope string, head_commit_hash string")
    latest = spark.createDataFrame([mr(1, "u", "major", 1, 2, "merged", T0)], MERGE_REQUESTS).withColumn(
        "head_commit_hash", F.lit("h1"))
    d = decisions(seen, latest)
    assert sorted(tuple(r) for r in d.select("scope", "decision").collect()) == [
        ("s1", "skip"), ("s2", "sync"), ("s3", "sync")]
    new = record_last_seen(seen, d, spark.createDataFrame([("s2",)], "scope string"))
    assert sorted(tuple(r) for r in new.collect()) == [("s1", "h1"), ("s2", "h1"), ("s3", "old")]
    none = decisions(seen, latest.limit(0))
    assert {r["decision"] for r in none.collect()} == {"none"}
    unmerged = decisions(seen, latest.withColumn("status", F.lit("open")))
    assert sorted(tuple(r) for r in unmerged.select("scope", "decision").collect()) == [
        ("s1", "skip"), ("s2", "refuse"), ("s3", "refuse")]


def test_instants_ignore_session_zone(spark):
    from feedloom.operators.checks import iso_instant_ntz

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in spark.createDataFrame([("2024-03-10T02:30:00.000Z",), ("2024-02-30T00:00:00Z",)],
                                                   "s string").select(iso_instant_ntz(F.col("s"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [dt.datetime(2024, 3, 10, 2, 30), None]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_a_join_and_splits_hot_keys(spark, how):
    from feedloom.operators.routing import hot_keys, salted_join

    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("skill"))
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("gone", 3)] + [(f"k{i}", i) for i in range(0, 997, 2)], "skill string, scope long")
    hot = spark.range(1).select(hot_keys(rows, "skill", 24)).first()[0]
    assert hot == {"hot": 8}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = salted_join(rows, small, "skill", how=how, parts=24)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in text and "NestedLoop" not in text
        assert sorted(map(str, got.select(*rows.join(small, "skill", how).columns).collect())) == sorted(map(str, rows.join(small, "skill", how).collect()))
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        plain = sorted(r["count"] for r in rows.join(small, "skill", how).groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2] and sizes[-1] < plain[-1]
    finally:
        for k in conf:
            spark.conf.unset(k)

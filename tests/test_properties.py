"""Property tests (hypothesis): each draws a batch of cases and checks them in one Spark job."""

import csv
import io
import json
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

SETTINGS = settings(max_examples=5, deadline=None)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 10 ** 9), st.integers(0, 10 ** 9)), min_size=1, max_size=50))
def test_rate_label_is_nearest_to_the_double(spark, pairs):
    from feedloom.functions.text import rate_label

    got = [r[0] for r in spark.createDataFrame(pairs, "c long, i long").select(
        rate_label(F.col("c"), F.col("i"))).collect()]
    for (c, i), label in zip(pairs, got):
        if i == 0:
            assert label == "0.0%"
        else:
            want = (Decimal(c / i * 100) * 10).quantize(Decimal(1), rounding=ROUND_HALF_UP)  # of the exact DOUBLE
            assert label == f"{int(want) // 10}.{int(want) % 10}%"


@SETTINGS
@given(st.lists(st.text(alphabet=st.sampled_from(list('ab ,"\n\r;é')), max_size=12), min_size=1, max_size=40))
def test_csv_cells_round_trip(spark, texts):
    from feedloom.functions.csv import csv_line

    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)], "i long, a string, b string")
    lines = {r["i"]: r["l"] for r in df.select("i", csv_line([F.col("a"), F.col("b")]).alias("l")).collect()}
    for i, t in enumerate(texts):
        parsed = next(csv.reader(io.StringIO(lines[i]), strict=True))
        assert parsed == [t, t[::-1]]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["minor", "major"]), st.integers(1, 10 ** 15), st.integers(0, 10 ** 6)),
                min_size=1, max_size=30))
def test_title_round_trip(spark, rows):
    import datetime as dt

    from feedloom.functions.titles import parse_title, render_title

    data = [(t, s, s + w, dt.date(2024, 1, 1)) for t, s, w in rows]
    df = spark.createDataFrame(data, "t string, s long, e long, d date")
    p = parse_title(render_title(F.col("t"), F.col("s"), F.col("e"), F.col("d"))).alias("p")
    got = [tuple(r["p"]) for r in df.select(p).collect()]
    assert got == [(t, s, e, None) for t, s, e, _ in data]


@SETTINGS
@given(st.lists(st.floats(min_value=0, max_value=1, allow_nan=False), min_size=1, max_size=40))
def test_js_number_text_parses_back(spark, values):
    from feedloom.functions.csv import js_number_text

    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(
        js_number_text(F.col("x"))).collect()]
    for v, text in zip(values, got):
        assert float(text) == v
        assert "E" not in text and not text.endswith(".0")


def test_invocation_ingest_and_status_updates(spark):
    from feedloom.operators.checks import errors_text
    from feedloom.schemas import MERGE_REQUESTS
    from feedloom.sources.ingest import ingest_invocations, validate_status_updates

    base = {"skill_name": "s", "working_directory": "/r", "tech_stack": ["ts"],
            "started_at": "2026-06-11T18:02:00.000Z", "status": "success"}
    cases = [{}, {"finished_at": None}, {"finished_at": "2026-06-11T18:03:00Z"}, {"status": "done"},
             {"finished_at": "yesterday"}, {"skill_name": "feedback-rules-x"}]
    raw = spark.createDataFrame([(i, json.dumps({**base, **c})) for i, c in enumerate(cases)],
                                "arrival long, payload string")
    valid, rejected = ingest_invocations(raw, high_water_mark=50)
    assert sorted((r["arrival"], r["id"]) for r in valid.select("arrival", "id").collect()) == [(0, 51), (1, 52),
                                                                                               (2, 53)]
    errs = dict(rejected.select("arrival", errors_text(F.col("errors"))).collect())
    assert errs == {3: "status:enum", 4: "finished_at:format", 5: "skill_name:reserved"}

    import datetime as dt
    t = dt.datetime(2026, 6, 11)
    mrs = spark.createDataFrame([(1, "u", "x", "h", "major", 1, 2, "open", t, None, None)], MERGE_REQUESTS)
    ups = [(1, 1, '{"status": "merged", "merged_at": "2026-06-12T00:00:00Z"}'),
           (2, 1, '{"status": "merged"}'), (3, 9, '{"status": "closed"}'), (4, 0, '{"status": "open"}'),
           (5, 1, '{"status": "open", "merged_at": null}')]
    raw = spark.createDataFrame(ups, "arrival long, id long, payload string")
    ok, bad = validate_status_updates(raw, mrs)
    assert sorted(r["arrival"] for r in ok.collect()) == [1, 5]
    assert dict(bad.select("arrival", errors_text(F.col("errors"))).collect()) == {
        2: "merged_at:merged_at_status", 3: "id:not_found", 4: "id:invalid_id"}


POST_COLS = ["title", "head_commit_hash", "iteration_type", "feedback_id_start", "feedback_id_end", "status",
             "opened_at", "merged_at"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3", "u4"]), st.sampled_from(["open", "merged", "closed"]),
                          st.integers(1, 50), st.booleans()), min_size=1, max_size=25),
       st.integers(0, 20))
def test_upsert_equals_sequential_posts(spark, posts, hwm_extra):
    """Batch upsert == the service's one-post-at-a-time update, incl. kept ids and purged_at."""
    import datetime as dt

    from feedloom.operators.upgrades import upsert
    from feedloom.schemas import MERGE_REQUESTS

    t0 = dt.datetime(2026, 1, 1)
    old_rows = [(3, "u2", "t", "h", "major", 1, 2, "merged", t0, t0, t0)]  # purged already
    hwm = 3 + hwm_extra
    table = {r[1]: dict(zip([f.name for f in MERGE_REQUESTS.fields], r)) for r in old_rows}
    next_id = hwm
    rows = []
    for arrival, (url, status, start, merged_flag) in enumerate(posts):
        merged = t0 + dt.timedelta(days=arrival) if status == "merged" and merged_flag else None
        post = dict(title=f"p{arrival}", head_commit_hash=f"h{arrival}", iteration_type="minor",
                    feedback_id_start=start, feedback_id_end=start + 1, status=status,
                    opened_at=t0 + dt.timedelta(hours=arrival), merged_at=merged)
        rows.append((arrival, url, *[post[c] for c in POST_COLS]))
        if url in table:
            table[url].update(post)  # id and purged_at kept
        else:
            next_id += 1
            table[url] = dict(id=next_id, mr_url=url, purged_at=None, **post)
    posts_df = spark.createDataFrame(rows, "arrival long, mr_url string, title string, head_commit_hash string, "
                                     "iteration_type string, feedback_id_start long, feedback_id_end long, "
                                     "status string, opened_at timestamp_ntz, merged_at timestamp_ntz")
    got = {r["mr_url"]: r.asDict() for r in upsert(spark.createDataFrame(old_rows, MERGE_REQUESTS), posts_df,
                                                   hwm).collect()}
    assert got == table

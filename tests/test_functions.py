"""Golden micro-cases of the scalar functions (FIXTURES.md A7)."""

import datetime as dt

from pyspark.sql import functions as F


def one(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_csv_escape_golden(spark):
    from feedloom.functions.csv import csv_cell

    got = one(spark, csv_cell(F.col("s")), [("hello, world",), ('quote "inside"',), ("line\nbreak",), (None,),
                                            ("plain",), ("cr\r",)], "s string")
    assert got == ['"hello, world"', '"quote ""inside"""', '"line\nbreak"', "", "plain", '"cr\r"']


def test_csv_line_keeps_null_cells(spark):
    from feedloom.functions.csv import csv_line

    got = one(spark, csv_line([F.col("a"), F.col("b"), F.col("c")]), [("a", None, "b")], "a string, b string, c string")
    assert got == ["a,,b"]


def test_js_number_text(spark):
    from feedloom.functions.csv import js_number_text

    vals = [0.0, 1.0, 0.29, 0.1, 1e-4, 1.5e-4, 1e-7, 1.25e-7, 123456789.5, 2.0, -0.5, 1e21, 1e-6]
    got = one(spark, js_number_text(F.col("x")), [(v,) for v in vals], "x double")
    assert got == ["0", "1", "0.29", "0.1", "0.0001", "0.00015", "1e-7", "1.25e-7", "123456789.5", "2", "-0.5",
                   "1e+21", "0.000001"]


def test_html_escape(spark):
    from feedloom.functions.text import html_escape

    got = one(spark, html_escape(F.col("s")), [('custom<script>"skill',), ("a&b'c",), (None,)], "s string")
    assert got == ["custom&lt;script&gt;&quot;skill", "a&amp;b&#39;c", ""]


def test_rate_label(spark):
    from feedloom.functions.text import rate_label

    rows = [(1, 2), (0, 1), (1, 3), (2, 1), (1, 16), (3, 0), (0, 0), (3, 2000), (9, 2000), (23, 2000)]
    got = one(spark, rate_label(F.col("c"), F.col("i")), rows, "c long, i long")
    assert got == ["50.0%", "0.0%", "33.3%", "200.0%", "6.3%", "0.0%", "0.0%", "0.1%", "0.4%", "1.1%"]


def test_title_parse_cases(spark):
    from feedloom.functions.titles import parse_title

    titles = [("[skills-feedback][minor][feedback:1200-1488] 2026-06-17 skill updates",),
              ("[skills-feedback][minor][feedback:9-2] invalid",),
              ("skill updates",),
              ("[skills-feedback][major][feedback:1-3]",),
              ("[skills-feedback][major][feedback:1-99999999999999999999] x",),
              ("[skills-feedback][major][feedback:1-3] x\n",)]
    rows = spark.createDataFrame(titles, "t string").select(parse_title(F.col("t")).alias("p")).collect()
    p = [r["p"] for r in rows]
    assert (p[0]["iteration_type"], p[0]["feedback_id_start"], p[0]["feedback_id_end"], p[0]["error"]) == (
        "minor", 1200, 1488, None)
    assert p[1]["error"] == "range_order"
    assert p[2]["error"] == "invalid_title"
    assert p[3]["error"] == "invalid_title"  # needs white space and more text
    assert p[4]["error"] == "invalid_title"  # id beyond BIGINT
    assert p[5]["error"] == "invalid_title"  # final newline is not "any character"


def test_title_render_round_trip(spark):
    from feedloom.functions.titles import branch_name, parse_title, render_title

    df = spark.createDataFrame([("major", 5, 9, dt.date(2024, 1, 29))], "t string, s long, e long, d date")
    r = df.select(render_title(F.col("t"), F.col("s"), F.col("e"), F.col("d")).alias("title"),
                  branch_name(F.col("t"), F.col("d"), F.col("d")).alias("b")).first()
    assert r["title"] == "[skills-feedback][major][feedback:5-9] 2024-01-29 skill review"
    assert r["b"] == "skills-feedback/major-2024-01-29-2024-01-29"
    p = spark.createDataFrame([(r["title"],)], "t string").select(parse_title(F.col("t")).alias("p")).first()["p"]
    assert (p["iteration_type"], p["feedback_id_start"], p["feedback_id_end"]) == ("major", 5, 9)


def test_reserved_names(spark):
    from feedloom.functions.names import is_reserved_skill

    names = ["feedback-rules", "feedback-rules-team", "feedback-rules-", "feedback-rulesX", "feedback-rules\n", "x"]
    got = one(spark, is_reserved_skill(F.col("s")), [(n,) for n in names], "s string")
    assert got == [True, True, False, False, False, False]


def test_scope_errors_golden(spark):
    from feedloom.functions.scopes import canonical_server_url, scope_errors

    rows = [("bad_scope", "http://a.lan:4321", ["s"]),
            ("ok", "http://0.0.0.0:4321", ["s"]),
            ("ok", "http://a.lan:4321?token=bad", ["s"]),
            ("ok", "http://a.lan:4321#section", ["s"]),
            ("ok", "javascript:alert(1)", ["s"]),
            ("ok", "HTTP://A.lan:80/", ["feedback-rules-x"]),
            ("ok-2", "https://a.lan/", ["line\nbreak", " "])]
    df = spark.createDataFrame(rows, "s string, u string, k array<string>")
    got = df.select(F.array_join(scope_errors(F.col("s"), F.col("u"), F.col("k")), ",").alias("e"),
                    canonical_server_url(F.col("u")).alias("c")).collect()
    assert [r["e"] for r in got] == ["scope_format", "url_unroutable_host", "url_query", "url_fragment",
                                     "url_scheme", "skills_reserved", "skills_multiline"]
    assert got[5]["c"] == "http://a.lan"
    assert got[0]["c"] == "http://a.lan:4321"


def test_split_skills(spark):
    from feedloom.functions.scopes import split_skills

    got = one(spark, split_skills(F.col("s")), [(" a, b ,,c ,",)], "s string")
    assert got == [["a", "b", "c"]]


def test_upgrade_decision_order(spark):
    from feedloom.functions.scopes import upgrade_decision

    rows = [(False, None, None, None), (True, "", "merged", "h"), (True, "h", "open", "h"),
            (True, "h", "open", "g"), (True, "h", "merged", None)]
    got = one(spark, upgrade_decision(F.col("e"), F.col("h"), F.col("s"), F.col("l")), rows,
              "e boolean, h string, s string, l string")
    assert got == ["none", "error_missing_hash", "skip", "refuse", "sync"]


def test_purge_reasons(spark):
    from feedloom.functions.purge_rules import display_reason, purge_eligible, refusal_reason

    ts = dt.datetime(2024, 1, 2)
    rows = [("major", "open", None, None), ("minor", "merged", ts, None), ("major", "merged", None, None),
            ("major", "merged", ts, ts), ("major", "merged", ts, None), ("major", "closed", None, None)]
    df = spark.createDataFrame(rows, "t string, s string, m timestamp_ntz, p timestamp_ntz")
    a = [F.col("t"), F.col("s"), F.col("m"), F.col("p")]
    got = df.select(purge_eligible(*a), refusal_reason(*a), display_reason(*a)).collect()
    assert [tuple(r) for r in got] == [
        (False, "not_merged", "not_merged"), (False, "not_major", "not_major"),
        (False, "missing_merged_at", "missing_merged_at"), (False, "already_purged", "already_purged"),
        (True, None, "eligible"), (False, "not_merged", "closed")]


def test_confidence_rules(spark):
    from feedloom.functions.routing import confidence_tier, review_flag

    vals = [0.8, 0.79, 0.6, 0.59, 1.0, 0.0, 1.5, float("nan")]
    got = spark.createDataFrame([(v,) for v in vals], "c double").select(
        confidence_tier(F.col("c")), review_flag(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("report", False), ("review", True), ("review", True), ("drop", False),
                                       ("report", False), ("drop", False), ("invalid", False), ("invalid", False)]


def test_signals_default_phrases(spark):
    from feedloom.functions.routing import correction_signals, is_reportable_type

    df = spark.createDataFrame([("不对，你没考虑缓存",), ("好的谢谢",)], "t string")
    got = df.select(correction_signals(F.col("t")).alias("s")).collect()
    assert got[0]["s"] == ["explicit_negation", "missing_requirement"]
    assert got[1]["s"] == []
    t = spark.createDataFrame([("mixed", ["x"]), ("mixed", []), ("correction", []), ("guidance", ["x"])],
                              "t string, s array<string>")
    assert [r[0] for r in t.select(is_reportable_type(F.col("t"), F.col("s"))).collect()] == [True, False, True, False]


def test_iteration_slots(spark):
    from feedloom.functions.iterations import iteration_slot, iteration_type, major_slot

    anchor = dt.date(2024, 1, 1)
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 7, 23, 59), dt.datetime(2024, 1, 8),
            dt.datetime(2024, 1, 28), dt.datetime(2024, 1, 29)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp_ntz")
    s = iteration_slot(F.col("t"), anchor, 7)
    got = df.select(s, iteration_type(s, 4), major_slot(s, 4)).collect()
    assert [tuple(r) for r in got] == [(1, "minor", 4), (1, "minor", 4), (2, "minor", 4), (4, "major", 4),
                                       (5, "minor", 8)]

"""Plan shape of every registered query: no nested-loop or Cartesian joins (range
joins are bucketed equi-joins) and no Python evaluation (everything stays in the JVM)."""

import pytest

import __spark_entry__ as E
from feedloom.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"]


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that run their jobs while they are built and return a stored result; other queries hold the same plans.
STORED = ("stream_", "ingest_", "rejected_i", "rejected_m", "rejected_s", "purge_committed", "purge_by_day", "purge_refusals", "purge_audit_committed")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(STORED)))
def test_plan_shape(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    bad = [op for op in FORBIDDEN if op in text]
    assert not bad, f"{name}: {bad}"


def test_date_filter_reaches_scan(spark, tmp_path):
    """On a stored table the bounds are pushed into the Parquet scan and prune day folders.
    (On the fixture view they must stay above the id numbering, which depends on all rows.)"""
    from pyspark.sql import functions as F

    from feedloom.operators.export import in_date_range
    from feedloom.sources.fixtures import fx_corrections

    path = str(tmp_path / "cor")
    (fx_corrections(spark, SF).withColumn("created_day", F.to_date("created_at"))
     .write.partitionBy("created_day").parquet(path))
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        in_date_range(spark.read.parquet(path), "2024-01-05", "2024-01-12").select("id").explain("formatted")
    text = buf.getvalue()
    assert "GreaterThanOrEqual(created_at,2024-01-05T00:00)" in text
    assert "LessThan(created_at,2024-01-13T00:00)" in text
    assert "PartitionFilters: [isnotnull(created_day" in text and "(created_day" in text
    assert "ReadSchema: struct<id:bigint,created_at:timestamp_ntz>" in text


def test_skill_stats_single_hash_shuffle(spark):
    from feedloom.operators.stats import skill_stats
    from feedloom.sources.fixtures import fx_invocations

    inv = fx_invocations(spark, SF)
    df = skill_stats(inv, inv.select("skill_name"), ordered=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["covered_counts", "covered_counts_wide", "purge_survivors", "purge_audit", "purge_wide_survivors", "purge_wide_audit"])
def test_range_joins_are_pure_equi_joins(spark, name):
    """Range joins meet rows by block keys and ranks only: no join compares a column
    with another column by range, so no row is paired with the ranges of its block."""
    import re

    text = plan_text(E.queries()[name](spark, SF))
    joins = [ln for ln in text.splitlines() if re.search(r"(HashJoin|SortMergeJoin|NestedLoopJoin)", ln)]
    assert joins
    column_range = re.compile(r"(<=|>=|<|>)\s*\(*[A-Za-z_]\w*#\d+")
    bad = [ln.strip() for ln in joins if column_range.search(ln)]
    assert not bad, bad


@pytest.mark.parametrize("name", ["skill_stats", "skill_stats_join_form", "totals", "corrections_by_skill", "skill_universe", "rate_label"])
def test_queries_without_ids_number_nothing(spark, name):
    df = E.queries()[name](spark, SF)
    text = plan_text(df)
    assert "Scan ExistingRDD" not in text
    assert "props" not in text and "event_id" not in text  # only the skill's columns are read


def test_registered_date_query_pushes_its_bounds(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        text = plan_text(E.queries()["corrections_in_range"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "props" not in text


def test_numbering_stores_nothing(spark):
    text = plan_text(E.queries()["assigned_ids"](spark, SF))
    assert "Scan ExistingRDD" not in text and "rangepartitioning" not in text


def test_counting_moves_ids_of_edge_blocks_only(spark):
    """The counts per block are summed before their exchange; ids themselves travel only where a range ends."""
    from feedloom.operators.ranges import count_in_ranges

    rows = spark.range(1000).select("id")
    ranges = spark.createDataFrame([(1, 5, 7)], "id long, feedback_id_start long, feedback_id_end long")
    text = plan_text(count_in_ranges(ranges, rows))
    assert "partial_sum" in text and "LeftSemi" in text


@pytest.mark.parametrize("name", ["covered_counts_wide", "purge_wide_survivors", "purge_wide_audit"])
def test_range_queries_are_compiled(spark, name):
    """No operator falls back from generated code (it did while ranges were cut into nine block levels)."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        E.queries()[name](spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_turn_pairs_exchange_the_texts_once(spark):
    """The whole texts go through one exchange; the edges of the buckets reuse it."""
    import re

    from feedloom.operators.routing import turn_pairs
    from feedloom.sources.fixtures import fx_turn_source

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(turn_pairs(fx_turn_source(spark, SF)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole = [ln for ln in text.splitlines() if re.search(r"Exchange hashpartitioning\(conv_id#\d+L?, _b#", ln)]
    assert ["ReusedExchange" in ln for ln in whole] == [False, True, True]

"""Streaming runs equal batch runs on the same data."""

import os

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_ingest_many_batches_dense_ids(spark, tmp_path):
    from feedloom.operators.checks import CORRECTION_FIELDS, validate
    from feedloom.sources.fixtures import fx_raw_posts
    from feedloom.streaming.ingest import start_ingest

    src = str(tmp_path / "src")
    raw = fx_raw_posts(spark, SF)
    raw.repartitionByRange(5, "arrival").write.json(src)
    q = start_ingest(spark, src, str(tmp_path / "sink"), str(tmp_path / "ck"), start_high_water_mark=100,
                     max_files_per_trigger=1)
    q.awaitTermination()
    valid = spark.read.parquet(str(tmp_path / "sink" / "valid"))
    ids = sorted(r[0] for r in valid.select("id").collect())
    n = len(ids)
    assert ids == list(range(101, 101 + n))  # dense, no repeats, after the mark
    batch_valid, batch_rej = validate(raw, CORRECTION_FIELDS, keep=["arrival"], reserved_skill_field="skill_name")
    assert n == batch_valid.count()
    assert spark.read.parquet(str(tmp_path / "sink" / "rejected")).count() == batch_rej.count()
    marks = spark.read.parquet(str(tmp_path / "sink" / "marks")).agg(F.max("high_water_mark")).first()[0]
    assert marks == 100 + n
    # ids follow arrival inside each batch
    per = valid.groupBy("batch_id").agg(F.corr("arrival", "id").alias("c")).collect()
    assert all(r["c"] is None or r["c"] > 0.999 for r in per)


def test_mr_feed_matches_batch_upsert(spark, tmp_path):
    from feedloom.operators.upgrades import empty_merge_requests, upsert
    from feedloom.sources.fixtures import fx_upgrade_posts
    from feedloom.streaming.changes import read_merge_requests, start_mr_feed

    posts = fx_upgrade_posts(spark, SF)
    src = str(tmp_path / "posts")
    posts.repartitionByRange(4, "arrival").write.parquet(src)
    files = sorted(f for f in os.listdir(src) if f.startswith("part-"))
    # touch files in arrival order so the file source takes them in that order
    for i, f in enumerate(files):
        os.utime(os.path.join(src, f), (1_700_000_000 + i, 1_700_000_000 + i))
    start_mr_feed(spark, src, str(tmp_path / "base"), str(tmp_path / "ck"), max_files_per_trigger=1).awaitTermination()
    streamed = {tuple(r) for r in read_merge_requests(spark, str(tmp_path / "base")).collect()}
    batch = {tuple(r) for r in upsert(empty_merge_requests(spark), posts).collect()}
    assert streamed == batch


def test_ingest_raw_lines(spark, tmp_path):
    from feedloom.streaming.ingest import start_ingest

    src = tmp_path / "feed"
    src.mkdir()
    good = {"skill_name": "s", "working_directory": "/r", "tech_stack": [], "ai_output": "a",
            "user_correction_input": "u", "classification_confidence": 0.7, "needs_batch_review": True,
            "created_at": "2026-06-11T18:02:00.000Z"}
    import json
    lines = [json.dumps({**good, "ai_output": f"a{i}"}) for i in range(5)] + ['{"skill_name": 1}', "oops"]
    (src / "part-0.jsonl").write_text("\n".join(lines) + "\n")
    start_ingest(spark, str(src), str(tmp_path / "sink"), str(tmp_path / "ck"), raw_lines=True,
                 start_high_water_mark=7).awaitTermination()
    valid = spark.read.parquet(str(tmp_path / "sink" / "valid"))
    got = sorted((r["id"], r["ai_output"]) for r in valid.select("id", "ai_output").collect())
    assert got == [(8 + i, f"a{i}") for i in range(5)]  # ids follow line order
    assert spark.read.parquet(str(tmp_path / "sink" / "rejected")).count() == 2


def _files_in_order(spark, frames, path):
    """Write each frame as its own file in ``path``, with increasing modification times."""
    import os
    import shutil

    os.makedirs(path, exist_ok=True)
    for i, df in enumerate(frames):
        tmp = f"{path}_tmp{i}"
        df.coalesce(1).write.parquet(tmp)
        part = [f for f in os.listdir(tmp) if f.startswith("part-")][0]
        dst = os.path.join(path, f"part-{i:05d}.parquet")
        shutil.copy(os.path.join(tmp, part), dst)
        os.utime(dst, (1_700_000_000 + i, 1_700_000_000 + i))


def test_windows_watermark_drops_late_rows(spark, tmp_path):
    import datetime as dt

    from feedloom.streaming.windows import read_windows, start_windows

    t = dt.datetime
    schema = "id long, created_at timestamp_ntz"
    batches = [spark.createDataFrame([(1, t(2024, 1, 2)), (2, t(2024, 2, 20))], schema),
               spark.createDataFrame([(4, t(2024, 2, 21)), (5, t(2024, 2, 12))], schema),
               spark.createDataFrame([(3, t(2024, 1, 3))], schema)]
    src = str(tmp_path / "src")
    _files_in_order(spark, batches, src)
    start_windows(spark, src, str(tmp_path / "sink"), str(tmp_path / "ck"), dt.date(2024, 1, 1), 7,
                  lateness="10 days", available_now=True, max_files_per_trigger=1).awaitTermination()
    got = {r["window_start"]: r["correction_count"] for r in read_windows(spark, str(tmp_path / "sink")).collect()}
    # batch 0 moves the watermark to Feb 10. Spark filters late input with the
    # watermark of the batch before, so batch 2 drops the Jan 3 row, while the
    # Feb 12 row of batch 1 is within the lateness and counted.
    assert got[t(2024, 1, 1)] == 1
    assert got[t(2024, 2, 19)] == 2
    assert got[t(2024, 2, 12)] == 1


def test_windows_count_late_rows_by_default(spark, tmp_path):
    import datetime as dt

    from feedloom.streaming.windows import read_windows, start_windows

    t = dt.datetime
    schema = "id long, created_at timestamp_ntz"
    batches = [spark.createDataFrame([(1, t(2024, 1, 2)), (2, t(2024, 4, 20))], schema),
               spark.createDataFrame([(4, t(2024, 4, 21))], schema), spark.createDataFrame([(3, t(2024, 1, 3))], schema)]
    _files_in_order(spark, batches, str(tmp_path / "src"))
    start_windows(spark, str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck"), dt.date(2024, 1, 1), 7,
                  max_files_per_trigger=1).awaitTermination()
    got = {r["window_start"]: r["correction_count"] for r in read_windows(spark, str(tmp_path / "sink")).collect()}
    assert got[t(2024, 1, 1)] == 2 and sum(got.values()) == 4


def test_a_missing_mark_stops_the_ingest(spark, tmp_path):
    import pytest

    from feedloom.streaming.ingest import _previous_mark

    spark.createDataFrame([(5,)], "high_water_mark long").write.parquet(str(tmp_path / "batch_id=0"))
    assert _previous_mark(spark, str(tmp_path), 1, 0) == 5
    with pytest.raises(ValueError):
        _previous_mark(spark, str(tmp_path), 2, 0)


def test_stats_changelog_over_batches(spark, tmp_path):
    from feedloom.operators.stats import skill_stats
    from feedloom.streaming.stats import read_stats, start_stats

    inv = [spark.createDataFrame([("a",), ("b",)], "skill_name string"),
           spark.createDataFrame([("a",), ("c",)], "skill_name string")]
    cor = [spark.createDataFrame([("a",)], "skill_name string"),
           spark.createDataFrame([("d",), ("a",)], "skill_name string")]
    _files_in_order(spark, inv, str(tmp_path / "inv"))
    _files_in_order(spark, cor, str(tmp_path / "cor"))
    q = start_stats(spark, str(tmp_path / "inv"), str(tmp_path / "cor"), str(tmp_path / "sink"),
                    str(tmp_path / "ck"), max_files_per_trigger=1)
    q.awaitTermination()
    assert len(spark.read.parquet(str(tmp_path / "sink")).select("batch_id").distinct().collect()) >= 2
    got = {tuple(r) for r in read_stats(spark, str(tmp_path / "sink")).collect()}
    from functools import reduce

    all_inv = reduce(lambda x, y: x.unionByName(y), inv)
    all_cor = reduce(lambda x, y: x.unionByName(y), cor)
    want = {tuple(r) for r in skill_stats(all_inv, all_cor, ordered=False).collect()}
    assert got == want


def test_iterations_of_a_stream_keep_late_rows_aside(spark, tmp_path):
    import datetime as dt

    from feedloom.operators.iterations import summary
    from feedloom.streaming.iterations import read_iterations, read_late, start_iterations

    t = dt.datetime
    schema = "id long, skill_name string, created_at timestamp_ntz"
    batches = [spark.createDataFrame([(1, "b", t(2024, 1, 2)), (2, "a", t(2024, 2, 20))], schema),
               spark.createDataFrame([(4, "a", t(2024, 2, 21)), (5, "c", t(2024, 2, 12)), (6, "a", t(2024, 2, 10)), (7, "a", t(2024, 2, 9, 23, 59))], schema),
               spark.createDataFrame([(3, "b", t(2024, 1, 3)), (8, "b", t(2024, 3, 1))], schema)]
    _files_in_order(spark, batches, str(tmp_path / "src"))
    args = (dt.date(2024, 1, 1), 7, 4)
    start_iterations(spark, str(tmp_path / "src"), str(tmp_path / "all"), str(tmp_path / "ck"), *args, max_files_per_trigger=1).awaitTermination()
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    got = sorted(map(tuple, read_iterations(spark, str(tmp_path / "all"), *args).collect()))
    assert got == sorted(map(tuple, summary(every, *args).collect())) and {r[1] for r in got} == {"minor", "major"}
    assert read_late(spark, str(tmp_path / "all")).count() == 0
    start_iterations(spark, str(tmp_path / "src"), str(tmp_path / "some"), str(tmp_path / "ck2"), *args, lateness=dt.timedelta(days=10),
                     max_files_per_trigger=1).awaitTermination()
    # ten days before Feb 20 is Feb 10 (not late itself); before Feb 21, Feb 11
    assert sorted(r.id for r in read_late(spark, str(tmp_path / "some")).collect()) == [3, 7]
    got = sorted(map(tuple, read_iterations(spark, str(tmp_path / "some"), *args).collect()))
    assert got == sorted(map(tuple, summary(every.filter("id NOT IN (3, 7)"), *args).collect()))


def test_mr_state_is_kept_per_bucket(spark, tmp_path):
    """A batch writes its buckets only, a retried one the same again, and every n-th version holds all."""
    import datetime as dt

    from feedloom.operators.upgrades import empty_merge_requests, upsert
    from feedloom.streaming import changes

    t = dt.datetime(2024, 1, 1)
    post = lambda a, u, h: (a, u, "x", h, "major", a, a + 1, "open", t, None, None)
    batches = [spark.createDataFrame([post(1, "u1", "a"), post(2, "u2", "b"), post(3, "u3", "c")], changes.POST_SCHEMA),
               spark.createDataFrame([post(4, "u2", "d")], changes.POST_SCHEMA),
               spark.createDataFrame([post(5, "u4", "e"), (6, None, None, None, None, None, None, "merged", None, t, 1), (7, None, None, None, None, None, None, "closed", None, None, 99)], changes.POST_SCHEMA)]
    src, base = str(tmp_path / "src"), tmp_path / "base"
    _files_in_order(spark, batches, src)
    changes.start_mr_feed(spark, src, str(base), str(tmp_path / "ck"), max_files_per_trigger=1, buckets=16, compact_every=3).awaitTermination()
    held = {v: len(list((base / "merge_requests" / f"v={v}").glob("bucket=*"))) for v in (1, 2, 3)}
    assert held[2] == 1 and held[3] >= held[1]
    state = {r.mr_url: (r.id, r.head_commit_hash, r.status) for r in changes.read_merge_requests(spark, str(base)).collect()}
    assert state == {"u1": (1, "a", "merged"), "u2": (2, "d", "open"), "u3": (3, "c", "open"), "u4": (4, "e", "open")}
    assert [tuple(r) for r in changes.read_status_errors(spark, str(base)).collect()] == [(7, 99, "not_found")]
    posts = batches[0].unionByName(batches[1]).unionByName(batches[2]).filter("mr_url IS NOT NULL").drop("id")
    assert {r.id for r in upsert(empty_merge_requests(spark), posts).collect()} == {1, 2, 3, 4}

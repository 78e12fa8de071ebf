"""Benchmark of the headline operators.

Setup (not timed): the fixture views over ``$BENCH_SF_DIR`` are written once
as stored Parquet tables (corrections partitioned by created day, as a
deployment would store them). Timed: each operator over the stored tables,
forced with a ``noop`` write (full computation, nothing collected), median of
5 runs after one warm-up. Prints one JSON line.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from feedloom.session import build_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
ONLY = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
PARTITIONS = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "0")) or max(8, 2 * CPUS)


def sf_of(path: str) -> str:
    base = os.path.basename(path)
    return base[2:] if base.startswith("sf") else base


def main() -> None:
    spark = build_session(master=f"local[{CPUS}]", shuffle_partitions=PARTITIONS, app="feedloom-bench",
                          extra={"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
                                 "spark.sql.adaptive.coalescePartitions.parallelismFirst":
                                     os.environ.get("BENCH_PARALLELISM_FIRST", "true")})
    from feedloom.operators import stats
    from feedloom.operators.export import export_lines, in_date_range
    from feedloom.operators.purge import purge
    from feedloom.operators.ranges import count_in_ranges
    from feedloom.operators.routing import turn_pairs
    from feedloom.operators.upgrades import empty_merge_requests, upsert
    from feedloom.sources import fixtures as fx
    from feedloom.sources.ingest import validate_corrections

    from feedloom.session import scratch_path

    work = scratch_path(spark, "bench")  # under the session's shared folder (spark.checkpoint.dir)
    # ---- setup: stored tables, several files each as a stored table has (the
    # driver's inputs are single files, which would make every scan one task) ----
    files = 2 * CPUS
    fx.fx_invocations(spark, SF_DIR).repartition(files).write.parquet(f"{work}/invocations")
    (fx.fx_corrections(spark, SF_DIR).withColumn("created_day", F.to_date("created_at"))
     .repartition(files, "created_day").write.partitionBy("created_day").parquet(f"{work}/corrections"))
    # the range-join variant of FIXTURES.md (ranges up to 400 wide over 15000 starts)
    (fx.fx_upgrade_posts(spark, SF_DIR, start_mod=15000, width_mod=400).repartition(files)
     .write.parquet(f"{work}/posts"))
    upsert(empty_merge_requests(spark), spark.read.parquet(f"{work}/posts")).write.parquet(f"{work}/mrs")
    fx.fx_raw_posts(spark, SF_DIR).repartition(files).write.parquet(f"{work}/raw_posts")
    raw_rows = spark.read.parquet(f"{work}/raw_posts").count()
    ranges = fx.fx_upgrade_posts(spark, SF_DIR, start_mod=15000, width_mod=400).select(
        F.col("arrival").alias("id"), "feedback_id_start", "feedback_id_end")
    ranges.repartition(files).write.parquet(f"{work}/ranges")
    fx.fx_turn_source(spark, SF_DIR).repartition(files).write.parquet(f"{work}/conversations")

    inv = lambda: spark.read.parquet(f"{work}/invocations")
    cor = lambda: spark.read.parquet(f"{work}/corrections").drop("created_day")
    mrs = lambda: spark.read.parquet(f"{work}/mrs")

    queries = {
        "skill_stats": lambda: stats.skill_stats(inv(), cor()),
        "covered_counts": lambda: count_in_ranges(spark.read.parquet(f"{work}/ranges"), cor()),
        "date_range_filter": lambda: in_date_range(spark.read.parquet(f"{work}/corrections"), "2024-01-05", "2024-01-12"),
        "export_csv_lines": lambda: export_lines(spark.read.parquet(f"{work}/corrections"), "2024-01-01", "2024-01-30"),
        "purge": lambda: purge(cor(), mrs(), dt.datetime(2024, 6, 1)).survivors,
        "purge_audit": lambda: purge(cor(), mrs(), dt.datetime(2024, 6, 1)).audit,
        "validate_ingest": lambda: validate_corrections(spark.read.parquet(f"{work}/raw_posts"))[0],
        "mr_upsert": lambda: upsert(empty_merge_requests(spark), spark.read.parquet(f"{work}/posts")),
        "turn_pairs": lambda: turn_pairs(spark.read.parquet(f"{work}/conversations")),
    }
    results = {}
    for name, build in queries.items():
        if ONLY and name not in ONLY:
            continue
        times = []
        for i in range(RUNS + 1):
            t0 = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            if i > 0:
                times.append(time.perf_counter() - t0)
        results[name] = round(statistics.median(times), 4)
    total = round(sum(results.values()), 4)
    extra = {}
    if "validate_ingest" in results:
        extra["ingest_payloads_per_sec"] = round(raw_rows / results["validate_ingest"])
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": total, "unit": "sec", "queries": results,
                      **extra, "sf": sf_of(SF_DIR), "cpus": CPUS, "runs": RUNS,
                      "spark": {"shuffle_partitions": PARTITIONS, "aqe": True}}))
    spark.stop()


if __name__ == "__main__":
    main()

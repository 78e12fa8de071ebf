"""ST3: merge-request change feed as keyed state in buckets.

The MR table is stored as ``v=<n>/bucket=<hash of mr_url>``. Batch n reads the state after batch
n-1, which is each bucket's newest version up to n, applies its posts (M1) and status
updates (M2), and writes version n+1 of the buckets it touches, nothing else. Every
``compact_every``-th version holds all buckets, so a state is found in the versions since. A row with
``mr_url`` is a post; a row without one changes the status of the MR ``id``. Both are taken in arrival
order: an update before the MR's first post is a ``not_found`` error, one before its
last post is overwritten by it. A retried batch reads the same older versions and
overwrites its own: idempotent by batch id. MRs are never deleted, so the largest id in the
state is the high-water mark.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.upgrades import apply_status_updates, empty_merge_requests, upsert
from ..schemas import MERGE_REQUESTS
from .common import write_batch

POST_SCHEMA = ("arrival long, mr_url string, title string, head_commit_hash string, iteration_type string, "
               "feedback_id_start long, feedback_id_end long, status string, opened_at timestamp_ntz, "
               "merged_at timestamp_ntz, id long")
BUCKETS = 64
COMPACT_EVERY = 32


def _bucket(url: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, base: str) -> DataFrame | None:
    """Every version of every bucket with its rows, or None before the first batch."""
    try:
        return spark.read.schema(MERGE_REQUESTS.simpleString()[7:-1].replace(":", " ") + ", v long, bucket int").parquet(f"{base}/merge_requests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _state(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """MR columns and ``bucket`` as of a version (default: the newest): each bucket's newest one, by its folder names."""
    rows = _versions(spark, base)
    if rows is None:
        return empty_merge_requests(spark).withColumn("bucket", F.lit(0))
    if version is not None:
        rows = rows.filter(F.col("v") <= version)
    newest = rows.select("v", "bucket").distinct().groupBy("bucket").agg(F.max("v").alias("v"))
    return rows.join(newest, ["bucket", "v"], "left_semi").drop("v")


def _apply_in_order(new: DataFrame, posts: DataFrame, updates: DataFrame, hwm: Column) -> tuple[DataFrame, DataFrame]:
    """Status updates of a batch on the table its posts are in already: (table, not_found errors)."""
    span = posts.groupBy("mr_url").agg(F.min("arrival").alias("_first"), F.max("arrival").alias("_last"))
    own = new.select(F.col("id").alias("_id"), "mr_url").join(span, "mr_url").drop("mr_url")
    placed = updates.join(own, F.col("id") == F.col("_id"), "left")
    early = (F.col("_id") > hwm) & (F.col("arrival") < F.col("_first"))  # its MR is made later in the batch
    errors = placed.filter(F.coalesce(early, F.lit(False))).select("arrival", "id", F.lit("not_found").alias("error"))
    table, unknown = apply_status_updates(new, placed.filter(F.col("_id").isNull() | (F.col("arrival") > F.col("_last")))
                                          .select("arrival", "id", "status", "merged_at"))
    return table, unknown.unionByName(errors)


def start_mr_feed(spark: SparkSession, source: str, base: str, checkpoint: str, available_now: bool = True,
                  max_files_per_trigger: int | None = None, buckets: int = BUCKETS, compact_every: int = COMPACT_EVERY):
    """``buckets`` must stay the same over the life of a table."""
    reader = spark.readStream.schema(POST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    feed = reader.parquet(source)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        state = _state(s, base, batch_id)
        hwm = F.coalesce(state.agg(F.max("id")).scalar(), F.lit(0))
        stage = f"{base}/_stage"  # each batch overwrites the one before it
        batch.write.mode("overwrite").parquet(f"{stage}/batch")  # evaluated once
        batch = s.read.schema(batch.schema).parquet(f"{stage}/batch")
        posts = batch.filter("mr_url is not null").drop("id")
        updates = batch.filter("mr_url is null").select("arrival", "id", "status", "merged_at")
        if (batch_id + 1) % compact_every:
            touched = (posts.select(_bucket(F.col("mr_url"), buckets).alias("bucket"))
                       .unionByName(state.join(updates.select("id"), "id", "left_semi").select("bucket")).distinct())
            old = state.join(touched, "bucket", "left_semi").drop("bucket")
        else:
            old = state.drop("bucket")
        upsert(old, posts, hwm).write.mode("overwrite").parquet(f"{stage}/new")
        table, errors = _apply_in_order(s.read.schema(MERGE_REQUESTS).parquet(f"{stage}/new"), posts, updates, hwm)
        (table.withColumn("bucket", _bucket(F.col("mr_url"), buckets)).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{base}/merge_requests/v={batch_id + 1}"))
        write_batch(errors, f"{base}/_status_errors", batch_id)

    w = feed.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_merge_requests(spark: SparkSession, base: str) -> DataFrame:
    return _state(spark, base).drop("bucket")


def read_status_errors(spark: SparkSession, base: str) -> DataFrame:
    """Status updates that named no MR: (arrival, id, error)."""
    return spark.read.schema("arrival long, id long, error string, batch_id int").parquet(f"{base}/_status_errors").drop("batch_id")

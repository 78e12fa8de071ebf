"""Merge requests: last write per key (W4), upsert (M1, J4, T8), status update
(M2, J5), latest MR (W2), id lookup (P6), title checks (V11, V12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.titles import parse_title
from ..schemas import MR_COLUMNS
from .ids import assign_ids

_POSTED = ["title", "head_commit_hash", "iteration_type", "feedback_id_start", "feedback_id_end", "status",
           "opened_at", "merged_at"]


def check_titles(posts: DataFrame) -> DataFrame:
    """F9 + V11 + V12 on schema-valid posts: adds ``title_error`` (NULL when the title
    parses and agrees with the payload's type and range)."""
    p = parse_title(F.col("title"))
    agree = ((p["iteration_type"] == F.col("iteration_type"))
             & (p["feedback_id_start"] == F.col("feedback_id_start"))
             & (p["feedback_id_end"] == F.col("feedback_id_end")))
    return posts.withColumn("title_error", F.when(p["error"].isNotNull(), p["error"])
                            .when(~F.coalesce(agree, F.lit(False)), F.lit("title_payload_mismatch")))


def last_post_per_url(posts: DataFrame) -> DataFrame:
    """The whole last post per mr_url (by arrival, NULLs included) and the first arrival.

    ``max_by`` of a struct is a combinable aggregate, so a hot URL is reduced
    map-side before the shuffle.
    """
    last = F.max_by(F.struct(*[F.col(c) for c in _POSTED]), F.col("arrival"))
    return (posts.groupBy("mr_url").agg(last.alias("_last"), F.min("arrival").alias("first_arrival"))
            .select("mr_url", "first_arrival", *[F.col(f"_last.{c}").alias(c) for c in _POSTED]))


def upsert(old: DataFrame, posts: DataFrame, high_water_mark: int = 0) -> DataFrame:
    """M1: posts (arrival + payload fields) applied to the MR table ``old``.

    A known URL keeps its id and its purged_at and takes every other field
    from its last post (a re-post after a purge stays purged and clears
    merged_at when the post has none). New URLs get ids after the
    high-water mark in first-arrival order (ids never come back after a purge).
    """
    last = last_post_per_url(posts)
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in MR_COLUMNS])
    j = o.join(last, o["_o_mr_url"] == last["mr_url"], "full_outer")
    matched_or_old = j.filter(F.col("_o_id").isNotNull()).select(
        F.col("_o_id").alias("id"),
        F.col("_o_mr_url").alias("mr_url"),
        *[F.when(F.col("mr_url").isNotNull(), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in _POSTED],
        F.col("_o_purged_at").alias("purged_at"),
    )
    # ids of new URLs depend only on (first arrival, url): number them from a
    # two-column aggregate, so the numbering never re-runs the whole-post aggregate
    new_urls = (posts.groupBy("mr_url").agg(F.min("arrival").alias("first_arrival"))
                .join(old.select("mr_url"), "mr_url", "left_anti"))
    ids = assign_ids(new_urls, ["first_arrival", "mr_url"], start_after=high_water_mark).select("mr_url", "id")
    fresh = j.filter(F.col("_o_id").isNull()).select("mr_url", *_POSTED).join(ids, "mr_url")
    fresh = fresh.select("id", "mr_url", *_POSTED, F.lit(None).cast("timestamp_ntz").alias("purged_at"))
    return matched_or_old.unionByName(fresh).select(*MR_COLUMNS)


def empty_merge_requests(spark) -> DataFrame:
    from ..schemas import MERGE_REQUESTS

    return spark.createDataFrame([], MERGE_REQUESTS)


def apply_status_updates(mrs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M2 + J5: (arrival, id, status, merged_at) updates applied in arrival order.

    Returns (new table, unknown-id errors). merged_at is replaced as sent, so
    an update without one clears it.
    """
    last = updates.groupBy("id").agg(F.max_by(F.struct("status", "merged_at"), F.col("arrival")).alias("_u"))
    known = mrs.select("id")
    errors = (updates.join(known, "id", "left_anti")
              .select("arrival", "id", F.lit("not_found").alias("error")))
    new = (mrs.join(last, "id", "left")
           .select("id", "mr_url", "title", "head_commit_hash", "iteration_type", "feedback_id_start",
                   "feedback_id_end",
                   F.when(F.col("_u").isNotNull(), F.col("_u.status")).otherwise(F.col("status")).alias("status"),
                   "opened_at",
                   F.when(F.col("_u").isNotNull(), F.col("_u.merged_at")).otherwise(F.col("merged_at"))
                   .alias("merged_at"),
                   "purged_at"))
    return new, errors


def latest(mrs: DataFrame) -> DataFrame:
    """Newest by (opened_at, id); one row or none (a top-1, no full sort)."""
    return mrs.orderBy(F.col("opened_at").desc(), F.col("id").desc()).limit(1)


def by_id(mrs: DataFrame, mr_id: int) -> DataFrame:
    """P6."""
    return mrs.filter(F.col("id") == F.lit(mr_id))

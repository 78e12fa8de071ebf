"""Purge of handled feedback: eligibility (F8), refusals (F10), range anti-join
(J3, M3), ownership on overlaps (W5, T9), audit rows (A10, M4), marking (M5)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.purge_rules import purge_eligible, refusal_reason
from ..schemas import CORRECTION_COLUMNS, MR_COLUMNS
from .ids import assign_ids
from .ranges import count_by_owner, owner_at, owner_steps


@dataclass
class PurgeResult:
    corrections: DataFrame
    mrs: DataFrame
    chosen: DataFrame      # the MRs that are purged, with their times
    refused: DataFrame     # requested MRs that were refused, with the reason
    audit_high_water_mark: int

    @cached_property
    def steps(self) -> DataFrame:
        return _steps(self.chosen)

    @cached_property
    def survivors(self) -> DataFrame:
        """Corrections left after the purge."""
        return _survivors(self.corrections, self.steps)

    @cached_property
    def marked(self) -> DataFrame:
        """The MR table with purged_at set on purged MRs."""
        return _marked(self.mrs, self.chosen)

    @cached_property
    def audit(self) -> DataFrame:
        """One row per purged MR, deleted_count may be 0."""
        return _audit_rows(self.chosen, _deleted(self.corrections, self.steps), self.audit_high_water_mark)


def _ntz(value: dt.datetime):
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def _marked(mrs: DataFrame, chosen: DataFrame) -> DataFrame:
    """M5: purged_at set on the purged MRs."""
    hit = chosen.select(F.col("id").alias("_hit"), "_at")
    return (mrs.join(hit, mrs["id"] == hit["_hit"], "left")
            .withColumn("purged_at", F.coalesce("_at", "purged_at")).select(*MR_COLUMNS))


def _audit_rows(chosen: DataFrame, deleted: DataFrame, high_water_mark: int | Column) -> DataFrame:
    """M4: one audit row per purged MR, deleted_count 0 when its range held nothing.

    Audit ids depend only on (purged_at, MR id), so they are numbered on the
    small MR side; the per-MR counts are joined afterwards, and the id
    numbering never re-runs the ownership join.
    """
    numbered = assign_ids(chosen.select(F.col("id").alias("merge_request_id"), "feedback_id_start",
                                        "feedback_id_end", F.col("_at").alias("purged_at")),
                          ["purged_at", "merge_request_id"], start_after=high_water_mark)
    return (numbered.join(deleted, "merge_request_id", "left")
            .select("id", "merge_request_id", "feedback_id_start", "feedback_id_end",
                    F.coalesce("deleted_count", F.lit(0)).cast("long").alias("deleted_count"), "purged_at"))


def _chosen(mrs: DataFrame, purged_at: dt.datetime, requests: DataFrame | None) -> DataFrame:
    """(id, feedback_id_start, feedback_id_end, _at) of the MRs to purge: all eligible ones, or those of the requests. A
    request may carry its own time in a column ``purged_at``; of several for one MR the earliest counts."""
    ok = mrs.filter(purge_eligible(F.col("iteration_type"), F.col("status"), F.col("merged_at"), F.col("purged_at")))
    ok = ok.select("id", "feedback_id_start", "feedback_id_end")
    if requests is None:
        return ok.withColumn("_at", _ntz(purged_at))
    at = F.min("purged_at") if "purged_at" in requests.columns else F.lit(None).cast("timestamp_ntz")
    times = requests.groupBy("id").agg(F.coalesce(at, _ntz(purged_at)).alias("_at"))
    return ok.join(times, "id")


def _steps(chosen: DataFrame) -> DataFrame:
    """The step function from ids to the purge that deletes them: the earliest one (time, then MR id)."""
    return owner_steps(chosen, F.struct("_at", "id"))


def _deleted(corrections: DataFrame, steps: DataFrame) -> DataFrame:
    """A10: deleted rows per MR, by ranks: no correction is moved for it."""
    return count_by_owner(corrections, steps, out="deleted_count").select(F.col("_own.id").alias("merge_request_id"), "deleted_count")


def _survivors(corrections: DataFrame, steps: DataFrame) -> DataFrame:
    """The corrections that no purge covers."""
    return owner_at(corrections, steps, out="_owner").filter(F.col("_owner").isNull()).select(*CORRECTION_COLUMNS)


def purge(corrections: DataFrame, mrs: DataFrame, purged_at: dt.datetime,
          requests: DataFrame | None = None, audit_high_water_mark: int = 0) -> PurgeResult:
    """M3-M5 on one snapshot.

    ``requests`` (column ``id``, and ``purged_at`` where purges differ in time) names the MRs to purge; without it every
    eligible MR is purged. Each deleted correction is counted for the earliest
    purge covering it (purged_at, then MR id), so audit counts sum to the
    number of deleted rows even when ranges overlap. The step function of the ranges is stored once (a
    checkpoint of the ranges' size) when a result is first asked for.
    """
    chosen = _chosen(mrs, purged_at, requests)
    refused = (mrs.filter(F.lit(False)).select("id", F.lit(None).cast("string").alias("reason")) if requests is None
               else _refusals(mrs, requests))
    return PurgeResult(corrections, mrs, chosen, refused, audit_high_water_mark)


def _refusals(mrs: DataFrame, requests: DataFrame) -> DataFrame:
    """F10 for every requested MR that may not be purged; ``not_found`` for ids that name none."""
    req = requests.select("id").distinct()
    why = refusal_reason(F.col("iteration_type"), F.col("status"), F.col("merged_at"), F.col("purged_at"))
    ok = purge_eligible(F.col("iteration_type"), F.col("status"), F.col("merged_at"), F.col("purged_at"))
    refused = mrs.join(req, "id", "left_semi").filter(~ok).select("id", why.alias("reason"))
    return refused.unionByName(req.join(mrs.select("id"), "id", "left_anti").select("id", F.lit("not_found").alias("reason")))


def purge_stored(spark, base: str, purged_at: dt.datetime, requests: DataFrame | None = None) -> DataFrame:
    """M3-M5 over the stored tables (``sources.sinks``): returns the refused requests (id, reason).

    Corrections and MRs are stored by id block. Only blocks that hold a purged id, or a purged MR, are read for
    it and replaced (dynamic partition overwrite), so purged text is gone from the disk at once. The steps come in an order
    that lets a purge that stopped half-way be called again: the audit rows are appended first; an MR
    that has one but is not marked yet is purged again with its own time, and keeps its count; deleting and
    marking give the same when repeated. One writer at a time, as with the service.
    """
    from ..schemas import CORRECTIONS, MERGE_REQUESTS, PURGE_AUDIT
    from ..session import shared_dir
    from ..sources import sinks

    shared_dir(spark)
    mrs, audit = sinks.read_blocks(spark, base, "merge_requests", MERGE_REQUESTS), sinks.read_stored(spark, base, "purge_audit", PURGE_AUDIT)
    corrections = sinks.read_blocks(spark, base, "corrections", CORRECTIONS)
    refused = (mrs.filter(F.lit(False)).select("id", F.lit(None).cast("string").alias("reason")) if requests is None
               else _refusals(mrs, requests)).checkpoint(eager=True)  # as the tables were before
    begun = (audit.select(F.col("merge_request_id").alias("id"), "feedback_id_start", "feedback_id_end", F.col("purged_at").alias("_at"))
             .join(mrs.filter("purged_at IS NULL").select("id"), "id", "left_semi").withColumn("_begun", F.lit(True)))
    new = _chosen(mrs, purged_at, requests).join(begun.select("id"), "id", "left_anti").withColumn("_begun", F.lit(False))
    chosen = begun.unionByName(new).checkpoint(eager=True)
    steps = _steps(chosen)
    last = F.coalesce(audit.agg(F.max("id")).scalar(), F.lit(0))
    sinks.append(_audit_rows(chosen.filter(~F.col("_begun")).drop("_begun"), _deleted(corrections, steps), last), f"{base}/purge_audit")
    touched = sinks.blocks_of_steps(spark, base, "corrections", steps)
    rows = sinks.read_blocks(spark, base, "corrections", CORRECTIONS, touched)
    days = sinks.read_days(spark, base, "corrections_by_day", CORRECTIONS)
    if days.inputFiles():  # the copy by day goes first: a purge called again finds its days from the blocks
        gone = owner_at(rows, steps, out="_owner").filter("_owner IS NOT NULL").select(F.to_date("created_at").alias(sinks.DAY_COL)).distinct()
        left = owner_at(days.join(gone, sinks.DAY_COL, "left_semi"), steps, out="_owner").filter("_owner IS NULL").drop("_owner")
        sinks.replace_days(left, gone, base, "corrections_by_day")
    sinks.replace_blocks(_survivors(rows, steps), touched, base, "corrections")
    marked = sinks.block_col(chosen).select(sinks.BLOCK_COL).distinct()
    sinks.replace_blocks(_marked(sinks.read_blocks(spark, base, "merge_requests", MERGE_REQUESTS, marked), chosen), marked, base, "merge_requests")
    return refused

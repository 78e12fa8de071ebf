"""The query catalogue: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads whole driver tables through the fixture views, so its work
grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import stats
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("skill_stats")
def q_skill_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.skill_stats(fx.fx_invocations(spark, sf_dir), fx.fx_corrections_plain(spark, sf_dir))


from .params import (ANCHOR, ASSIGN_HWM, EXPORT_FROM, EXPORT_TO, INSTANT_FROM, INSTANT_TO,  # noqa: E402
                     INTERVAL_DAYS, MAJOR_EVERY, PURGED_AT, RANGE_FROM, RANGE_TO, RECENT_N, TEXT_SIGNALS)


def _inv(spark, d):
    return fx.fx_invocations(spark, d)


def _cor(spark, d):
    return fx.fx_corrections(spark, d)


def _plain(spark, d):
    return fx.fx_corrections_plain(spark, d)


@query("skill_stats_join_form")
def q_skill_stats_join_form(spark, d):
    return stats.skill_stats_join_form(_inv(spark, d), _plain(spark, d))


@query("totals")
def q_totals(spark, d):
    return stats.totals(_inv(spark, d), _plain(spark, d))


@query("invocations_by_skill")
def q_invocations_by_skill(spark, d):
    return stats.count_by_skill(_inv(spark, d), "invocation_count")


@query("corrections_by_skill")
def q_corrections_by_skill(spark, d):
    return stats.count_by_skill(_plain(spark, d), "correction_count")


@query("skill_universe")
def q_skill_universe(spark, d):
    return stats.skill_universe(_inv(spark, d), _plain(spark, d))


@query("failure_rate")
def q_failure_rate(spark, d):
    return stats.failure_rate(_inv(spark, d))


@query("rate_label")
def q_rate_label(spark, d):
    s = stats.skill_stats(_inv(spark, d), _plain(spark, d), ordered=False)
    return stats.with_rate_label(s).select("skill_name", "invocation_count", "correction_count", "rate_label")


@query("recent_corrections")
def q_recent_corrections(spark, d):
    return stats.recent_corrections(_cor(spark, d), RECENT_N).select("id", "skill_name", "created_at")


@query("corrections_in_range")
def q_corrections_in_range(spark, d):
    from ..operators.export import in_date_range

    return in_date_range(_cor(spark, d), RANGE_FROM, RANGE_TO).select("id", "skill_name", "created_at")


@query("corrections_in_instant_range")
def q_corrections_in_instant_range(spark, d):
    from ..operators.export import in_date_range

    return in_date_range(_cor(spark, d), INSTANT_FROM, INSTANT_TO).select("id", "skill_name", "created_at")


@query("export_csv_lines")
def q_export_csv_lines(spark, d):
    from ..operators.export import export_lines

    return export_lines(_cor(spark, d), EXPORT_FROM, EXPORT_TO)


@query("csv_cells_documents")
def q_csv_cells_documents(spark, d):
    from ..functions.csv import csv_cell

    return fx.table(spark, d, "documents").select("doc_id", csv_cell(F.col("text")).alias("cell"))


@query("html_escape_pages")
def q_html_escape_pages(spark, d):
    from ..functions.text import html_escape

    return fx.table(spark, d, "pages").select("page_id", html_escape(F.col("html")).alias("escaped"))


def _validated(spark, d):
    from ..sources.ingest import validate_corrections

    return validate_corrections(fx.fx_raw_posts(spark, d))


@query("validate_posts")
def q_validate_posts(spark, d):
    valid, _ = _validated(spark, d)
    return valid.select("arrival", "skill_name", "working_directory", F.to_json("tech_stack").alias("tech_stack_json"),
                        "ai_output", "user_correction_input", "classification_confidence", "needs_batch_review",
                        "created_at")


@query("rejected_posts")
def q_rejected_posts(spark, d):
    from ..operators.checks import errors_text

    _, rejected = _validated(spark, d)
    return rejected.select("arrival", errors_text(F.col("errors")).alias("error_fields"))


@query("assigned_ids")
def q_assigned_ids(spark, d):
    from ..sources.ingest import ingest_corrections

    valid, _ = ingest_corrections(fx.fx_raw_posts(spark, d), high_water_mark=ASSIGN_HWM)
    return valid.select("arrival", "id")


@query("title_check")
def q_title_check(spark, d):
    from ..functions.titles import parse_title
    from ..operators.upgrades import check_titles

    posts = check_titles(fx.fx_upgrade_posts(spark, d))
    p = parse_title(F.col("title"))
    return posts.select("arrival", p["iteration_type"].alias("parsed_type"),
                        p["feedback_id_start"].alias("parsed_start"), p["feedback_id_end"].alias("parsed_end"),
                        "title_error")


def _mrs(spark, d):
    """The MR table upserted from the whole post feed, staged once (a reliable checkpoint
    in the shared folder): the queries over it read it as a stored table, several
    times, without re-running the upsert over the posts in every branch."""
    from ..operators.upgrades import empty_merge_requests, upsert
    from ..session import shared_dir

    shared_dir(spark)
    return upsert(empty_merge_requests(spark), fx.fx_upgrade_posts(spark, d)).checkpoint(eager=True)


@query("mr_upsert")
def q_mr_upsert(spark, d):
    return _mrs(spark, d)


@query("mr_status_update")
def q_mr_status_update(spark, d):
    from ..operators.upgrades import apply_status_updates

    new, _ = apply_status_updates(_mrs(spark, d), fx.fx_status_updates(spark, d))
    return new.select("id", "status", "merged_at")


@query("mr_status_errors")
def q_mr_status_errors(spark, d):
    from ..operators.upgrades import apply_status_updates

    _, errors = apply_status_updates(_mrs(spark, d), fx.fx_status_updates(spark, d))
    return errors


@query("latest_mr")
def q_latest_mr(spark, d):
    from ..operators.upgrades import latest

    return latest(_mrs(spark, d))


@query("covered_counts")
def q_covered_counts(spark, d):
    from ..operators.ranges import count_in_ranges

    return count_in_ranges(_mrs(spark, d), _cor(spark, d))


@query("covered_counts_wide")
def q_covered_counts_wide(spark, d):
    """Ranges that grow with the orders, whole blocks and ranges up to the largest valid id included."""
    from ..operators.ranges import count_in_ranges

    return count_in_ranges(fx.fx_wide_ranges(spark, d), _cor(spark, d))


@query("url_checks")
def q_url_checks(spark, d):
    from ..functions import urls

    u = F.col("url")
    return fx.fx_urls(spark, d).select("id", urls.is_http_url(u).alias("is_http"), urls.canonical(u).alias("canonical"))


@query("skill_lists")
def q_skill_lists(spark, d):
    from ..functions.scopes import split_skills

    return fx.fx_skill_lists(spark, d).select("id", F.array_join(split_skills(F.col("skills")), "|").alias("skills"))


@query("purge_eligibility")
def q_purge_eligibility(spark, d):
    from ..functions.purge_rules import display_reason, purge_eligible, refusal_reason
    from ..functions.text import status_label
    from ..functions.urls import is_http_url

    args = [F.col("iteration_type"), F.col("status"), F.col("merged_at"), F.col("purged_at")]
    return _mrs(spark, d).select("id", purge_eligible(*args).alias("eligible"),
                                 refusal_reason(*args).alias("refusal_reason"),
                                 display_reason(*args).alias("display_reason"),
                                 status_label(F.col("status")).alias("status_label"),
                                 is_http_url(F.col("mr_url")).alias("safe_link"))


def _purge(spark, d):
    from ..operators.purge import purge

    return purge(_cor(spark, d), _mrs(spark, d), PURGED_AT)


@query("purge_survivors")
def q_purge_survivors(spark, d):
    return _purge(spark, d).survivors.select("id", "skill_name")


@query("purge_audit")
def q_purge_audit(spark, d):
    return _purge(spark, d).audit


@query("purge_marked")
def q_purge_marked(spark, d):
    return _purge(spark, d).marked.select("id", "purged_at")


@query("integrity_violations")
def q_integrity_violations(spark, d):
    from ..operators.checks import at_rest_violations, correction_violations, orphan_audit_rows

    posts = fx.fx_upgrade_posts(spark, d).withColumnRenamed("arrival", "id")
    a = at_rest_violations(posts).withColumn("table_name", F.lit("merge_request_posts"))
    b = correction_violations(_cor(spark, d)).withColumn("table_name", F.lit("corrections"))
    res = _purge(spark, d)
    c = (orphan_audit_rows(res.audit, res.marked)
         .select(F.lit("purge_audit").alias("table_name"), "id", F.lit("orphan_merge_request").alias("check")))
    return a.unionByName(b).unionByName(c).select("table_name", "id", "check")


@query("turn_pairs")
def q_turn_pairs(spark, d):
    from ..operators.routing import turn_pairs

    return turn_pairs(fx.fx_turn_source(spark, d))


@query("confidence_tiers")
def q_confidence_tiers(spark, d):
    from ..operators.routing import tag_confidence

    return tag_confidence(_cor(spark, d))


@query("correction_signals")
def q_correction_signals(spark, d):
    from ..operators.routing import tag_signals, turn_pairs

    tagged = tag_signals(turn_pairs(fx.fx_turn_source(spark, d)), TEXT_SIGNALS)
    return tagged.select("conv_id", "turn", F.array_join("matched_signals", ",").alias("signals"),
                         F.size("matched_signals").cast("long").alias("signal_count"))


@query("tech_stack_default")
def q_tech_stack_default(spark, d):
    from ..functions.routing import tech_stack_or_unknown

    return _inv(spark, d).select("id", F.to_json(tech_stack_or_unknown(F.col("tech_stack"))).alias("tech_stack_json"))


@query("scope_conflicts")
def q_scope_conflicts(spark, d):
    from ..operators.routing import scope_conflicts

    return scope_conflicts(fx.fx_scopes(spark, d))


@query("scope_routing")
def q_scope_routing(spark, d):
    from ..operators.routing import route

    return route(_cor(spark, d), fx.fx_scopes(spark, d)).select("id", "feedback_scope")


@query("allow_list")
def q_allow_list(spark, d):
    from ..functions.routing import is_reportable_confidence
    from ..operators.routing import allow_list, invoked_only

    cor = invoked_only(_cor(spark, d), _inv(spark, d))
    cor = cor.filter(is_reportable_confidence(F.col("classification_confidence")))
    return allow_list(cor, fx.fx_scopes(spark, d)).select("feedback_scope", "id")


@query("scope_checks")
def q_scope_checks(spark, d):
    from ..operators.scopes import check_scopes

    c = check_scopes(fx.fx_scopes_with_broken(spark, d))
    return c.select("feedback_scope", F.array_join("errors", ",").alias("errors"), "server_url",
                    F.array_join("skills", ",").alias("skills"))


@query("upgrade_decisions")
def q_upgrade_decisions(spark, d):
    from ..operators.scopes import decisions, record_last_seen
    from ..operators.upgrades import latest

    seen = fx.fx_last_seen(spark, d)
    dec = decisions(seen, latest(_mrs(spark, d)))
    new = record_last_seen(seen, dec).withColumnRenamed("head_commit_hash", "new_hash")
    return dec.join(new, "scope").select("scope", "last_seen_hash", "latest_hash", "decision", "new_hash")


@query("iteration_summary")
def q_iteration_summary(spark, d):
    from ..operators.iterations import summary

    return summary(_cor(spark, d), ANCHOR, INTERVAL_DAYS, MAJOR_EVERY)


@query("iteration_skill_groups")
def q_iteration_skill_groups(spark, d):
    from ..operators.iterations import skill_groups

    return skill_groups(_cor(spark, d), ANCHOR, INTERVAL_DAYS, MAJOR_EVERY)


@query("skill_catalog")
def q_skill_catalog(spark, d):
    from ..sources.registry import skill_names

    docs = fx.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.concat(F.lit("name: "), F.col("source"), F.lit("\n"), F.col("text")).alias("content"))
    return skill_names(docs).select(F.col("path").cast("long").alias("doc_id"), "name")


# ---- streaming forms: each runs a finite (availableNow) stream over files
# written from the fixture views, then reads the sink ----

def _stream_dirs(spark, name):
    from ..session import scratch_path

    base = scratch_path(spark, name)
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


@query("stream_ingest")
def q_stream_ingest(spark, d):
    from ..streaming.ingest import start_ingest

    src, sink, ck = _stream_dirs(spark, "stream-ingest")
    fx.fx_raw_posts(spark, d).write.json(src)
    start_ingest(spark, src, sink, ck).awaitTermination()
    valid = spark.read.parquet(f"{sink}/valid")
    return valid.select("arrival", "skill_name", "working_directory", F.to_json("tech_stack").alias("tech_stack_json"),
                        "ai_output", "user_correction_input", "classification_confidence", "needs_batch_review",
                        "created_at")


@query("stream_stats")
def q_stream_stats(spark, d):
    from ..streaming.stats import read_stats, start_stats

    src, sink, ck = _stream_dirs(spark, "stream-stats")
    _inv(spark, d).select("skill_name").write.parquet(f"{src}/invocations")
    _plain(spark, d).select("skill_name").write.parquet(f"{src}/corrections")
    start_stats(spark, f"{src}/invocations", f"{src}/corrections", sink, ck).awaitTermination()
    return read_stats(spark, sink)


@query("stream_mr")
def q_stream_mr(spark, d):
    from ..streaming.changes import read_merge_requests, start_mr_feed

    src, sink, ck = _stream_dirs(spark, "stream-mr")
    fx.fx_upgrade_posts(spark, d).write.parquet(src)
    start_mr_feed(spark, src, sink, ck).awaitTermination()
    return read_merge_requests(spark, sink)


@query("stream_windows")
def q_stream_windows(spark, d):
    from ..streaming.windows import read_windows, start_windows

    src, sink, ck = _stream_dirs(spark, "stream-windows")
    _cor(spark, d).select("id", "created_at").write.parquet(src)
    start_windows(spark, src, sink, ck, ANCHOR, INTERVAL_DAYS).awaitTermination()
    return read_windows(spark, sink)


def _purged_store(spark, d, requests=None):
    """The fixtures stored, purged; (base, refused requests)."""
    from ..operators.purge import purge_stored
    from ..session import scratch_path
    from ..sources import sinks

    base = scratch_path(spark, "purge-store")
    sinks.append_blocks(_cor(spark, d), base, "corrections")
    sinks.append_blocks(_mrs(spark, d), base, "merge_requests")
    return base, purge_stored(spark, base, PURGED_AT, requests)


def _some_requests(spark, d):
    return fx.table(spark, d, "orders").select((F.col("o_orderkey") % 150).alias("id")).distinct()


@query("purge_committed")
def q_purge_committed(spark, d):
    """M3-M5 over the stored tables; the surviving corrections are read back."""
    from ..schemas import CORRECTIONS
    from ..sources import sinks

    base, _ = _purged_store(spark, d)
    return sinks.read_blocks(spark, base, "corrections", CORRECTIONS).select("id", "skill_name")


@query("purge_refusals")
def q_purge_refusals(spark, d):
    """F10 per requested MR, from the stored purge; ids that name no MR are ``not_found``."""
    return _purged_store(spark, d, _some_requests(spark, d))[1]


@query("purge_audit_committed")
def q_purge_audit_committed(spark, d):
    """The audit rows of the stored purge, read back."""
    from ..schemas import PURGE_AUDIT
    from ..sources import sinks

    base, _ = _purged_store(spark, d, _some_requests(spark, d))
    return sinks.read_stored(spark, base, "purge_audit", PURGE_AUDIT).select(
        "merge_request_id", "feedback_id_start", "feedback_id_end", "deleted_count")


def _purge_wide(spark, d):
    from ..operators.purge import purge

    mrs = fx.fx_wide_mrs(spark, d)
    requests = mrs.select("id", (F.lit(PURGED_AT).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id") % 5)).alias("purged_at"))
    return purge(_cor(spark, d), mrs, PURGED_AT, requests.filter("id % 3 < 2"))


@query("purge_wide_survivors")
def q_purge_wide_survivors(spark, d):
    """One MR per order, wide overlapping ranges up to the largest valid id, purged at five times."""
    return _purge_wide(spark, d).survivors.select("id", "skill_name")


@query("purge_wide_audit")
def q_purge_wide_audit(spark, d):
    return _purge_wide(spark, d).audit


@query("mr_by_id")
def q_mr_by_id(spark, d):
    from ..operators.upgrades import by_id

    return by_id(_mrs(spark, d), 5)


def _stream_changes(spark, d):
    from ..streaming.changes import start_mr_feed

    src, sink, ck = _stream_dirs(spark, "stream-mr-status")
    changes = fx.fx_mr_changes(spark, d)
    quarters = changes.agg(F.percentile_approx("arrival", [0.25, 0.5, 0.75]).alias("q")).first()["q"] or []
    for low, high in zip([None, *quarters], [*quarters, None]):  # four batches, in arrival order
        part = changes.filter(F.lit(True) if low is None else F.col("arrival") > low)
        part.filter(F.lit(True) if high is None else F.col("arrival") <= high).coalesce(1).write.mode("append").parquet(src)
    start_mr_feed(spark, src, sink, ck, max_files_per_trigger=1).awaitTermination()
    return sink


@query("stream_mr_status")
def q_stream_mr_status(spark, d):
    from ..streaming.changes import read_merge_requests

    return read_merge_requests(spark, _stream_changes(spark, d)).select("id", "mr_url", "title", "status", "merged_at")


@query("stream_mr_status_errors")
def q_stream_mr_status_errors(spark, d):
    from ..streaming.changes import read_status_errors

    return read_status_errors(spark, _stream_changes(spark, d))


# ---- ingest in one pass: checked rows are written once, valid and rejected apart, and read back ----

def _fanned(spark, checked, name, outcome):
    from ..session import scratch_path
    from ..sources.ingest import fan_out, read_outcome

    path = scratch_path(spark, name)
    fan_out(checked, path)
    return read_outcome(spark, path, outcome)


def _rejects(rows):
    from ..operators.checks import errors_text

    return rows.select("arrival", "payload", errors_text(F.col("errors")).alias("error_fields"))


def _checked_invocations(spark, d):
    from ..sources.ingest import checked_invocations

    return checked_invocations(fx.fx_raw_invocations(spark, d))


def _checked_mr_posts(spark, d):
    from ..sources.ingest import checked_mr_posts

    return checked_mr_posts(fx.fx_raw_mr_posts(spark, d))


def _checked_status(spark, d):
    from ..sources.ingest import checked_status_updates

    return checked_status_updates(fx.fx_raw_status(spark, d), _mrs(spark, d))


@query("ingest_invocations")
def q_ingest_invocations(spark, d):
    """S1 with ids (W3) over the stored valid rows."""
    from ..operators.ids import assign_ids

    valid = _fanned(spark, _checked_invocations(spark, d), "invocations", "valid")
    return assign_ids(valid, ["arrival"], start_after=ASSIGN_HWM).select("arrival", "id", "skill_name", "status", "finished_at")


@query("rejected_invocations")
def q_rejected_invocations(spark, d):
    return _rejects(_fanned(spark, _checked_invocations(spark, d), "invocations", "rejected"))


@query("ingest_mr_posts")
def q_ingest_mr_posts(spark, d):
    return _fanned(spark, _checked_mr_posts(spark, d), "mr-posts", "valid").select(
        "arrival", "iteration_type", "feedback_id_start", "feedback_id_end", "status", "merged_at")


@query("rejected_mr_posts")
def q_rejected_mr_posts(spark, d):
    return _rejects(_fanned(spark, _checked_mr_posts(spark, d), "mr-posts", "rejected"))


@query("ingest_status_updates")
def q_ingest_status_updates(spark, d):
    return _fanned(spark, _checked_status(spark, d), "status", "valid").select("arrival", "id", "status", "merged_at")


@query("rejected_status_updates")
def q_rejected_status_updates(spark, d):
    return _rejects(_fanned(spark, _checked_status(spark, d), "status", "rejected"))


@query("constraint_violations")
def q_constraint_violations(spark, d):
    """V14 and V15 over tables with a defect of every kind."""
    from ..operators.constraints import violations

    return violations(fx.fx_broken(spark, d))


# ---- the copy of the corrections by created day ----

def _by_day(spark, d):
    from ..schemas import CORRECTIONS
    from ..session import scratch_path
    from ..sources import sinks

    base = scratch_path(spark, "by-day")
    sinks.append_days(_cor(spark, d), base, "corrections_by_day")
    return sinks.read_days(spark, base, "corrections_by_day", CORRECTIONS)


@query("corrections_by_day")
def q_corrections_by_day(spark, d):
    """P1 on the day layout: the bounds prune day folders."""
    from ..operators.export import in_date_range

    return in_date_range(_by_day(spark, d), RANGE_FROM, RANGE_TO).select("id", "skill_name", "created_at")


@query("export_by_day")
def q_export_by_day(spark, d):
    from ..operators.export import export_lines

    return export_lines(_by_day(spark, d), EXPORT_FROM, EXPORT_TO)


@query("purge_by_day")
def q_purge_by_day(spark, d):
    """The day copy after a stored purge: only days that lost rows are replaced."""
    from ..operators.purge import purge_stored
    from ..schemas import CORRECTIONS
    from ..session import scratch_path
    from ..sources import sinks

    base = scratch_path(spark, "purge-store")
    sinks.append_blocks(_cor(spark, d), base, "corrections")
    sinks.append_days(_cor(spark, d), base, "corrections_by_day")
    sinks.append_blocks(_mrs(spark, d), base, "merge_requests")
    purge_stored(spark, base, PURGED_AT)
    return sinks.read_days(spark, base, "corrections_by_day", CORRECTIONS).select("id", "skill_name")


@query("stored_rows")
def q_stored_rows(spark, d):
    """P5 and back (P3): arrays as JSON text and flags as 0/1, decoded."""
    from ..operators.export import tech_stack_json
    from ..sources.tables import decode_stored_rows

    stored = _cor(spark, d).select("id", tech_stack_json(F.col("tech_stack")).alias("tech_stack_json"), F.col("needs_batch_review").cast("int").alias("needs_batch_review"))
    return decode_stored_rows(stored).select("id", F.array_join("tech_stack", "|").alias("tech_stack"), "needs_batch_review")


@query("corrections_in_id_range")
def q_corrections_in_id_range(spark, d):
    """P7."""
    from ..sources.tables import in_id_range

    return in_id_range(_cor(spark, d), 20, 120).select("id", "skill_name")


@query("count_in_id_range")
def q_count_in_id_range(spark, d):
    """A5."""
    from ..sources.tables import count_in_id_range

    return count_in_id_range(_cor(spark, d), 20, 120)


@query("reportable_turns")
def q_reportable_turns(spark, d):
    """Turns classified by role and length; mixed ones count only with a signal."""
    from ..functions.routing import correction_signals, is_reportable_type

    t = fx.fx_turn_source(spark, d)
    kind = F.when(F.col("role") != "user", "task").when(F.col("turn") % 3 == 0, "correction").otherwise("mixed")
    return t.filter(is_reportable_type(kind, correction_signals(F.col("text"), TEXT_SIGNALS))).select("conv_id", "turn")


@query("stream_iterations")
def q_stream_iterations(spark, d):
    """Minor and major iterations from a stream of three batches."""
    from ..streaming.iterations import read_iterations, start_iterations

    src, sink, ck = _stream_dirs(spark, "stream-iterations")
    for k in range(3):
        _cor(spark, d).select("id", "skill_name", "created_at").filter(F.col("id") % 3 == k).write.mode("append").parquet(src)
    start_iterations(spark, src, sink, ck, ANCHOR, INTERVAL_DAYS, MAJOR_EVERY, max_files_per_trigger=1).awaitTermination()
    return read_iterations(spark, sink, ANCHOR, INTERVAL_DAYS, MAJOR_EVERY)


@query("skill_files")
def q_skill_files(spark, d):
    """S8 over a folder tree: one skill file per source, read back with its path."""
    from ..session import scratch_path
    from ..sources.registry import skill_names

    root = scratch_path(spark, "skills")
    fx.fx_skill_files(spark, d).repartition("source").write.partitionBy("source").option("lineSep", "\n").text(root)
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(
        F.regexp_extract("_metadata.file_path", "source=([^/]+)/", 1).alias("path"), F.col("value").alias("content"))
    return skill_names(files)


@query("scope_manifests")
def q_scope_manifests(spark, d):
    """One manifest file per scope, read back with its path."""
    from ..session import scratch_path
    from ..sources.registry import read_scopes

    root = scratch_path(spark, "manifests")
    scopes = fx.fx_scopes(spark, d)
    (scopes.select(F.col("feedback_scope").alias("file"), F.to_json(F.struct("feedback_scope", "feedback_server_url", "reportable_skills")).alias("value"))
     .repartition("file").write.partitionBy("file").text(root))
    return read_scopes(spark, f"{root}/*/*").select("feedback_scope", "feedback_server_url", F.array_join("reportable_skills", ",").alias("skills"),
                                                    F.regexp_extract("file_path", "file=([^/]+)/", 1).alias("file"))


@query("skill_list_files")
def q_skill_list_files(spark, d):
    """One list file per nation, as an array, as an object, or as something else (NULL)."""
    from ..session import scratch_path
    from ..sources.registry import read_skill_lists

    root = scratch_path(spark, "lists")
    k = F.col("n_nationkey")
    name = F.concat(F.lit('"skill-'), k.cast("string"), F.lit('"'))
    text = (F.when(k % 4 == 0, F.concat(F.lit('["a",'), name, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit('{"skills":['), name, F.lit("]}")))
            .when(k % 4 == 2, F.concat(F.lit("["), name, F.lit(",5]"))).otherwise(F.lit("[]")))
    fx.table(spark, d, "nation").select(k.alias("list"), text.alias("value")).repartition("list").write.partitionBy("list").text(root)
    return read_skill_lists(spark, f"{root}/*/*").select(F.regexp_extract("file_path", "list=([^/]+)/", 1).cast("long").alias("list"),
                                                         F.array_join("skills", ",").alias("skills"))


@query("turn_pairs_long")
def q_turn_pairs_long(spark, d):
    """W1 on two conversations of many thousand turns: pairs across bucket edges too."""
    from ..operators.routing import turn_pairs

    return turn_pairs(fx.fx_long_turns(spark, d))


def _hot_corrections(spark, d):
    """The corrections, a third of them with one skill."""
    return _cor(spark, d).withColumn("skill_name", F.when(F.col("id") % 3 == 0, "skill-07").otherwise(F.col("skill_name")))


@query("scope_routing_hot")
def q_scope_routing_hot(spark, d):
    from ..operators.routing import route

    return route(_hot_corrections(spark, d), fx.fx_scopes(spark, d)).select("id", "feedback_scope")


@query("allow_list_hot")
def q_allow_list_hot(spark, d):
    from ..operators.routing import allow_list, invoked_only

    return allow_list(invoked_only(_hot_corrections(spark, d), _inv(spark, d)), fx.fx_scopes(spark, d)).select("feedback_scope", "id")


@query("upgrade_decisions_all")
def q_upgrade_decisions_all(spark, d):
    """Every decision and the state after it, half of the syncs failing, against five newest MRs: none, one
    without a hash, an open one, a merged one already seen by some, a closed one."""
    from ..operators.scopes import decisions, record_last_seen

    seen = fx.fx_last_seen(spark, d)
    newest = {"none": (None, None, False), "no_hash": ("", "merged", True), "open": ("hash1", "open", True), "merged": ("hash2", "merged", True),
              "closed": ("hash4", "closed", True)}
    out = None
    for name, (commit, status, there) in newest.items():
        mr = fx.table(spark, d, "orders").limit(1).select(F.lit(commit).cast("string").alias("head_commit_hash"), F.lit(status).cast("string").alias("status"))
        dec = decisions(seen, mr.filter(F.lit(there)))
        synced = seen.filter(F.length("scope") == 7).select("scope")
        new = record_last_seen(seen, dec, synced).withColumnRenamed("head_commit_hash", "new_hash")
        part = dec.join(new, "scope").select(F.lit(name).alias("newest"), "scope", "decision", "new_hash")
        out = part if out is None else out.unionByName(part)
    return out


@query("purge_reasons")
def q_purge_reasons(spark, d):
    """F8, F10, F11 over every combination of type, status, merge time and purge time."""
    from ..functions.purge_rules import display_reason, purge_eligible, refusal_reason

    k = F.col("o_orderkey")
    t = F.lit(PURGED_AT).cast("timestamp_ntz")
    args = [F.when(k % 2 == 0, "major").otherwise("minor"), F.element_at(F.array(F.lit("open"), F.lit("merged"), F.lit("closed")), (k % 3 + 1).cast("int")),
            F.when(k % 5 < 3, t), F.when(k % 7 < 2, t)]
    return fx.table(spark, d, "orders").select(k.alias("id"), purge_eligible(*args).alias("eligible"), refusal_reason(*args).alias("refusal_reason"),
                                               display_reason(*args).alias("display_reason"))


@query("tech_stack_empty")
def q_tech_stack_empty(spark, d):
    """F14 on missing, empty and filled stacks."""
    from ..functions.routing import tech_stack_or_unknown

    k = F.col("event_id")
    stack = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b")))
    return fx.table(spark, d, "events").select(k.alias("id"), F.array_join(tech_stack_or_unknown(stack), "|").alias("tech_stack"))


@query("review_flags")
def q_review_flags(spark, d):
    """V16, F12, F13 with sent flags that are wrong in every seventh row."""
    from ..operators.routing import tag_confidence

    wrong = F.col("id") % 7 == 0
    return tag_confidence(_cor(spark, d).withColumn("needs_batch_review", F.col("needs_batch_review") != wrong)).select("id", "flag_consistent")


@query("export_as_sent")
def q_export_as_sent(spark, d):
    """Ingest that keeps instants as sent, exported: the text of ``created_at`` comes out unchanged."""
    from ..operators.checks import CORRECTION_FIELDS, check
    from ..operators.export import csv_lines

    checked = check(fx.fx_posts_of_many_instants(spark, d), CORRECTION_FIELDS, keep=["arrival"], keep_sent=True)
    return csv_lines(checked.filter(F.size("errors") == 0).withColumnRenamed("arrival", "id"))

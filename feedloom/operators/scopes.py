"""Scope registry and upgrades: registry checks (V17, F6, F7, U2), upgrade
decision per scope (J9, F17) and last-seen state (M6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scopes import canonical_server_url, js_trim, scope_errors, upgrade_decision


def check_scopes(scopes: DataFrame) -> DataFrame:
    """V17 per manifest row: errors (codes), canonical URL and the cleaned, de-duplicated
    skill list (U2 keeps first occurrences in order)."""
    cleaned = F.array_distinct(F.filter(F.transform(F.coalesce("reportable_skills", F.array().cast("array<string>")),
                                                    js_trim), lambda x: x != ""))
    return scopes.select(
        "feedback_scope", "feedback_server_url",
        scope_errors(F.col("feedback_scope"), F.col("feedback_server_url"), F.col("reportable_skills"))
        .alias("errors"),
        canonical_server_url(F.col("feedback_server_url")).alias("server_url"),
        cleaned.alias("skills"))


def decisions(last_seen: DataFrame, latest_mr: DataFrame) -> DataFrame:
    """J9 + F17 for every scope at once.

    ``latest_mr`` has at most one row (W2's top-1); it enters as a scalar
    subquery returning one struct (NULL when there is no MR), evaluated once
    and shared by every scope row -- no join at all.
    """
    latest = latest_mr.limit(1).select(
        F.struct(F.col("head_commit_hash").alias("hash"), F.col("status").alias("status"))).scalar()
    return last_seen.select(
        "scope", F.col("head_commit_hash").alias("last_seen_hash"), latest["hash"].alias("latest_hash"),
        upgrade_decision(latest.isNotNull(), latest["hash"], latest["status"],
                         F.col("head_commit_hash")).alias("decision"))


def record_last_seen(last_seen: DataFrame, decided: DataFrame, synced: DataFrame | None = None) -> DataFrame:
    """M6: the latest hash is written only for scopes whose decision was ``sync`` and whose
    sync succeeded (``synced`` lists them by ``scope``; None means all succeeded)."""
    d = decided.filter(F.col("decision") == "sync").select("scope", "latest_hash")
    if synced is not None:
        d = d.join(synced.select("scope"), "scope", "left_semi")
    return (last_seen.join(d, "scope", "left")
            .select("scope", F.coalesce("latest_hash", "head_commit_hash").alias("head_commit_hash")))

"""Purge rules on a merge-request row: eligibility (F8) and refusal reasons."""

from pyspark.sql import Column, functions as F


def purge_eligible(iteration_type: Column, status: Column, merged_at: Column, purged_at: Column) -> Column:
    """F8: major, merged, merged_at set and not yet purged."""
    return F.coalesce((iteration_type == "major") & (status == "merged") & merged_at.isNotNull()
                      & purged_at.isNull(), F.lit(False))


def refusal_reason(iteration_type: Column, status: Column, merged_at: Column, purged_at: Column) -> Column:
    """the first failing guard in enforcement order; NULL when eligible."""
    return (F.when(F.coalesce(iteration_type != "major", F.lit(True)), F.lit("not_major"))
            .when(F.coalesce(status != "merged", F.lit(True)), F.lit("not_merged"))
            .when(merged_at.isNull(), F.lit("missing_merged_at"))
            .when(purged_at.isNotNull(), F.lit("already_purged")))


def display_reason(iteration_type: Column, status: Column, merged_at: Column, purged_at: Column) -> Column:
    """the reason shown next to the purge button, in display order."""
    return (F.when(purged_at.isNotNull(), F.lit("already_purged"))
            .when(status == "closed", F.lit("closed"))
            .when(F.coalesce(status != "merged", F.lit(True)), F.lit("not_merged"))
            .when(merged_at.isNull(), F.lit("missing_merged_at"))
            .when(F.coalesce(iteration_type != "major", F.lit(True)), F.lit("not_major"))
            .otherwise(F.lit("eligible")))

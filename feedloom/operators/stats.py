"""Roll-ups per skill: totals (A1), counts (A2, A3), skill statistics (A4, J1,
U1, O1), failure rate (A6), recent corrections (O4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import rate_label


def _tagged(invocations: DataFrame, corrections: DataFrame) -> DataFrame:
    """Both feeds as (skill_name, inv, cor) rows; only the skill column is read."""
    inv = invocations.select("skill_name", F.lit(1).alias("inv"), F.lit(0).alias("cor"))
    cor = corrections.select("skill_name", F.lit(0).alias("inv"), F.lit(1).alias("cor"))
    return inv.unionByName(cor)


def totals(invocations: DataFrame, corrections: DataFrame) -> DataFrame:
    """A1: one row, zeros when both feeds are empty. One global aggregate, no cross join."""
    return _tagged(invocations, corrections).agg(
        F.coalesce(F.sum("inv"), F.lit(0)).cast("long").alias("invocation_count"),
        F.coalesce(F.sum("cor"), F.lit(0)).cast("long").alias("correction_count"),
    )


def correction_rate(cor, inv):
    """0 when there are no invocations, never clipped, never NULL."""
    return F.when(inv == 0, F.lit(0.0)).otherwise(cor.cast("double") / inv.cast("double"))


def skill_stats(invocations: DataFrame, corrections: DataFrame, ordered: bool = True) -> DataFrame:
    """A4: skill universe with both counts and the correction rate, leaderboard order.

    One shuffle: the tagged union is grouped once (partial aggregation runs
    map-side, so a hot skill costs nothing extra).
    """
    out = (_tagged(invocations, corrections).groupBy("skill_name")
           .agg(F.sum("inv").cast("long").alias("invocation_count"),
                F.sum("cor").cast("long").alias("correction_count")))
    out = out.withColumn("correction_rate", correction_rate(F.col("correction_count"), F.col("invocation_count")))
    return leaderboard_order(out) if ordered else out


def leaderboard_order(stats: DataFrame) -> DataFrame:
    """O1: corrections desc, invocations desc, skill name asc (byte order)."""
    return stats.orderBy(F.col("correction_count").desc(), F.col("invocation_count").desc(),
                         F.col("skill_name").asc())


def skill_stats_join_form(invocations: DataFrame, corrections: DataFrame) -> DataFrame:
    """J1 in its literal form: distinct skill universe, two left joins. Same result as A4."""
    skills = invocations.select("skill_name").union(corrections.select("skill_name")).distinct()
    inv = count_by_skill(invocations, "invocation_count")
    cor = count_by_skill(corrections, "correction_count")
    out = (skills.join(inv, "skill_name", "left").join(cor, "skill_name", "left")
           .select("skill_name",
                   F.coalesce("invocation_count", F.lit(0)).cast("long").alias("invocation_count"),
                   F.coalesce("correction_count", F.lit(0)).cast("long").alias("correction_count")))
    out = out.withColumn("correction_rate", correction_rate(F.col("correction_count"), F.col("invocation_count")))
    return leaderboard_order(out)


def count_by_skill(df: DataFrame, name: str = "count") -> DataFrame:
    """A2 / A3: rows per skill."""
    return df.groupBy("skill_name").agg(F.count(F.lit(1)).alias(name))


def skill_universe(invocations: DataFrame, corrections: DataFrame) -> DataFrame:
    """Distinct union of the skills of both feeds."""
    return invocations.select("skill_name").union(corrections.select("skill_name")).distinct()


def failure_rate(invocations: DataFrame) -> DataFrame:
    """Failed / invocations per skill."""
    out = invocations.groupBy("skill_name").agg(
        F.count(F.lit(1)).alias("invocation_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"))
    return out.withColumn("failure_rate", F.col("failed_count").cast("double") / F.col("invocation_count"))


def with_rate_label(stats: DataFrame) -> DataFrame:
    """F3 on A4's rows."""
    return stats.withColumn("rate_label", rate_label(F.col("correction_count"), F.col("invocation_count")))


def recent_corrections(corrections: DataFrame, n: int = 20) -> DataFrame:
    """The n most recent corrections (created_at desc, id desc) -- a top-k, planned as
    TakeOrderedAndProject (per-partition top n, no full sort)."""
    return corrections.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)

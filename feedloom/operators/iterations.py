"""Iteration windows: summary per minor/major iteration (A7, F16, F18, F19) and
per-skill groups for review (A9).

A minor slot covers its own X days; slot kY is a major *instead of* a minor
and covers slots (k-1)Y+1 .. kY, so a correction can count for one minor and
one major iteration.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import compact
from ..functions.iterations import (DEFAULT_INTERVAL_DAYS, DEFAULT_MAJOR_EVERY, iteration_slot, major_slot)
from ..functions.titles import branch_name, render_title


def memberships(corrections: DataFrame, anchor: dt.date, interval_days: int = DEFAULT_INTERVAL_DAYS,
                major_every: int = DEFAULT_MAJOR_EVERY) -> DataFrame:
    """(iteration_slot, iteration_type, id, skill_name): one or two rows per correction."""
    slot = iteration_slot(F.col("created_at"), anchor, interval_days)
    base = corrections.select("id", "skill_name", slot.alias("_slot"))
    minor = F.struct(F.col("_slot").alias("s"), F.lit("minor").alias("t"))
    major = F.struct(major_slot(F.col("_slot"), major_every).alias("s"), F.lit("major").alias("t"))
    arms = compact([(F.pmod(F.col("_slot"), F.lit(major_every)) != 0, minor), (F.lit(True), major)],
                   "struct<s:bigint,t:string>")
    return (base.select("id", "skill_name", F.explode(arms).alias("_m"))
            .select(F.col("_m.s").alias("iteration_slot"), F.col("_m.t").alias("iteration_type"), "id",
                    "skill_name"))


def skill_groups(corrections: DataFrame, anchor: dt.date, interval_days: int = DEFAULT_INTERVAL_DAYS,
                 major_every: int = DEFAULT_MAJOR_EVERY) -> DataFrame:
    """Per iteration and skill, the count and id range of its corrections."""
    return (memberships(corrections, anchor, interval_days, major_every)
            .groupBy("iteration_slot", "iteration_type", "skill_name")
            .agg(F.count(F.lit(1)).alias("feedback_count"), F.min("id").alias("feedback_id_start"),
                 F.max("id").alias("feedback_id_end")))


def summary(corrections: DataFrame, anchor: dt.date, interval_days: int = DEFAULT_INTERVAL_DAYS,
            major_every: int = DEFAULT_MAJOR_EVERY) -> DataFrame:
    """Per iteration window with feedback: count, id range, sorted skills, MR title and branch.

    Rows are first reduced per (window, skill) (A9), so the skill list is
    collected from at most one row per distinct skill, never from raw rows.
    """
    return summary_of(skill_groups(corrections, anchor, interval_days, major_every), anchor, interval_days, major_every)


def summary_of(groups: DataFrame, anchor: dt.date, interval_days: int = DEFAULT_INTERVAL_DAYS,
               major_every: int = DEFAULT_MAJOR_EVERY) -> DataFrame:
    """A7 from the per-skill groups (A9), one row per iteration and skill."""
    s = (groups.groupBy("iteration_slot", "iteration_type")
         .agg(F.sum("feedback_count").cast("long").alias("feedback_count"),
              F.min("feedback_id_start").alias("feedback_id_start"),
              F.max("feedback_id_end").alias("feedback_id_end"),
              F.array_join(F.array_sort(F.collect_list("skill_name")), ",").alias("skills")))
    first_slot = F.when(F.col("iteration_type") == "major", F.col("iteration_slot") - major_every + 1) \
        .otherwise(F.col("iteration_slot"))
    day_from = F.date_add(F.lit(anchor), ((first_slot - 1) * interval_days).cast("int"))
    day_to = F.date_add(F.lit(anchor), (F.col("iteration_slot") * interval_days - 1).cast("int"))
    run_day = F.date_add(F.lit(anchor), (F.col("iteration_slot") * interval_days).cast("int"))
    return s.select(
        "iteration_slot", "iteration_type", "feedback_count", "feedback_id_start", "feedback_id_end", "skills",
        F.date_format(day_from, "yyyy-MM-dd").alias("window_from"),
        F.date_format(day_to, "yyyy-MM-dd").alias("window_to"),
        render_title(F.col("iteration_type"), F.col("feedback_id_start"), F.col("feedback_id_end"), run_day)
        .alias("mr_title"),
        branch_name(F.col("iteration_type"), day_from, day_to).alias("branch"))

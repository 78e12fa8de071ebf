"""Correction routing rules: confidence tier (F12), review flag (F13),
tech-stack default (F14), correction signals (F15), reportable type (P9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import compact

# Confidence thresholds of the reporting rules.
REPORT_THRESHOLD = 0.8
REVIEW_THRESHOLD = 0.6

# The correction-signal families of the rules text, with its
# example phrases (the first two names are the rules' own; the last three are
# named here).
SIGNAL_FAMILIES = {
    "explicit_negation": ["不对", "错了", "不是这个", "你理解错了"],
    "missing_requirement": ["没考虑", "少了", "不完整", "没有覆盖"],
    "replacement_correction": ["应该是", "我说的是"],
    "failed_result": ["跑不通", "报错", "不符合规则"],
    "boundary_correction": ["只适用于", "不适用于"],
}


def in_unit_range(c: Column) -> Column:
    """Two-sided check, so NaN and NULL are outside (NaN >= x is true in Spark)."""
    return F.coalesce(c.between(0.0, 1.0) & ~F.isnan(c), F.lit(False))


def confidence_tier(c: Column) -> Column:
    """report (>= 0.8), review (0.6 <= c < 0.8), drop (< 0.6), invalid (outside [0,1])."""
    return (F.when(~in_unit_range(c), F.lit("invalid"))
            .when(c >= REPORT_THRESHOLD, F.lit("report"))
            .when(c >= REVIEW_THRESHOLD, F.lit("review"))
            .otherwise(F.lit("drop")))


def review_flag(c: Column) -> Column:
    """needs_batch_review is exactly 0.6 <= c < 0.8."""
    return F.coalesce(in_unit_range(c) & (c >= REVIEW_THRESHOLD) & (c < REPORT_THRESHOLD), F.lit(False))


def is_reportable_confidence(c: Column) -> Column:
    """C >= 0.6 inside [0, 1]."""
    return F.coalesce(in_unit_range(c) & (c >= REVIEW_THRESHOLD), F.lit(False))


def tech_stack_or_unknown(tech: Column) -> Column:
    """an empty or missing tech stack becomes ``["unknown"]``."""
    return F.when(tech.isNull() | (F.size(tech) == 0), F.array(F.lit("unknown"))).otherwise(tech)


def correction_signals(text: Column, families: dict[str, list[str]] | None = None) -> Column:
    """names of the families with a phrase occurring in ``text`` (literal, case-sensitive)."""
    fams = families or SIGNAL_FAMILIES
    arms = []
    for name, phrases in fams.items():
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.coalesce(F.instr(text, p) > 0, F.lit(False))
        arms.append((hit, F.lit(name)))
    return compact(arms, "string")


def is_reportable_type(input_type: Column, signals: Column) -> Column:
    """``correction``, or ``mixed`` that carries a correction signal."""
    return F.coalesce((input_type == "correction")
                      | ((input_type == "mixed") & (F.size(signals) > 0)), F.lit(False))

"""Merge-request titles: parse (F9), render (F18), branch names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import JS_SPACE

# The title form ``[skills-feedback][<type>][feedback:<a>-<b>] <text>``
# and the branch prefix.
TITLE_PATTERN = (r"^\[skills-feedback\]\[(minor|major)\]\[feedback:([0-9]+)-([0-9]+)\]"
                 + JS_SPACE + r"+[^\n\r\u2028\u2029]+\z")
BRANCH_PREFIX = "skills-feedback/"
TITLE_SUFFIX = {"minor": "skill updates", "major": "skill review"}


def parse_title(title: Column) -> Column:
    """struct(iteration_type, feedback_id_start, feedback_id_end, error).

    ``error`` is NULL when the title parses; ``invalid_title`` when it does not
    match or an id does not fit a BIGINT; ``range_order`` when start > end.
    """
    matches = F.coalesce(title.rlike(TITLE_PATTERN), F.lit(False))
    typ = F.when(matches, F.regexp_extract(title, TITLE_PATTERN, 1))
    start = F.when(matches, F.regexp_extract(title, TITLE_PATTERN, 2)).try_cast("bigint")
    end = F.when(matches, F.regexp_extract(title, TITLE_PATTERN, 3)).try_cast("bigint")
    err = (F.when(~matches | start.isNull() | end.isNull(), F.lit("invalid_title"))
           .when(start > end, F.lit("range_order")))
    ok = err.isNull()
    return F.struct(
        F.when(ok, typ).alias("iteration_type"),
        F.when(ok, start).alias("feedback_id_start"),
        F.when(ok, end).alias("feedback_id_end"),
        err.alias("error"),
    )


def render_title(iteration_type: Column, start: Column, end: Column, day: Column) -> Column:
    """``[skills-feedback][type][feedback:a-b] <yyyy-MM-dd> skill updates|review``."""
    suffix = F.when(iteration_type == "major", F.lit(TITLE_SUFFIX["major"])).otherwise(F.lit(TITLE_SUFFIX["minor"]))
    return F.concat(F.lit("[skills-feedback]["), iteration_type, F.lit("][feedback:"), start.cast("string"),
                    F.lit("-"), end.cast("string"), F.lit("] "), F.date_format(day, "yyyy-MM-dd"), F.lit(" "), suffix)


def branch_name(iteration_type: Column, day_from: Column, day_to: Column) -> Column:
    """``skills-feedback/<type>-<from>-<to>`` with ISO dates."""
    return F.concat(F.lit(BRANCH_PREFIX), F.concat_ws("-", iteration_type, F.date_format(day_from, "yyyy-MM-dd"),
                                                      F.date_format(day_to, "yyyy-MM-dd")))

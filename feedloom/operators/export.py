"""Date-range export: bound normalising (P2), range filter (P1), export
projection (P4), CSV line column (K2), array text (P5)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.csv import csv_line, js_number_text

# Fixed value: the export's nine columns, in order.
EXPORT_COLUMNS = ["id", "skill_name", "working_directory", "tech_stack", "ai_output", "user_correction_input",
                  "classification_confidence", "needs_batch_review", "created_at"]

_DATE_ONLY = re.compile(r"^\d{4}-\d{2}-\d{2}$")
_INSTANT = re.compile(r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2})(:\d{2})?(\.\d+)?Z$")


def _ntz_literal(value: dt.datetime) -> Column:
    """A typed TIMESTAMP_NTZ literal, so the comparison stays on the column's type and
    reaches the Parquet scan as a pushed filter."""
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def normalize_bounds(date_from: str, date_to: str) -> tuple[dt.datetime, dt.datetime, bool]:
    """Returns (lower, upper, upper_inclusive).

    Both bounds are required. A date-only ``to`` covers its whole day (half-open
    at the next midnight, so microseconds after .999 are kept); a full UTC
    instant stays a closed bound. An unparsable bound raises.
    """
    if not date_from or not date_to:
        raise ValueError("from and to are required")

    def parse(v: str, upper: bool):
        if _DATE_ONLY.match(v):
            d = dt.datetime.strptime(v, "%Y-%m-%d")
            return (d + dt.timedelta(days=1), False) if upper else (d, True)
        m = _INSTANT.match(v)
        if not m:
            raise ValueError(f"unparsable bound: {v!r}")
        if m.group(4) and not m.group(3):
            raise ValueError(f"unparsable bound: {v!r}")
        # digits below microseconds: stored instants have none, so a lower bound that has them lies before the next microsecond
        frac = (m.group(4) or ".0")[1:].ljust(6, "0")
        at = dt.datetime.strptime(f"{m.group(1)} {m.group(2)}{m.group(3) or ':00'}", "%Y-%m-%d %H:%M:%S").replace(microsecond=int(frac[:6]))
        return (at + dt.timedelta(microseconds=1) if not upper and frac[6:].strip("0") else at), True

    lo, _ = parse(date_from, False)
    hi, inclusive = parse(date_to, True)
    return lo, hi, inclusive


def in_date_range(corrections: DataFrame, date_from: str, date_to: str,
                  partition_col: str = "created_day") -> DataFrame:
    """P1 with P2's bounds; ``from > to`` gives no rows.

    The bounds are typed TIMESTAMP_NTZ literals, so they reach the Parquet scan
    as pushed filters; when the table is stored partitioned by created day
    (``partition_col``), the same bounds on that column prune whole folders.
    """
    lo, hi, inclusive = normalize_bounds(date_from, date_to)
    c = F.col("created_at")
    upper = (c <= _ntz_literal(hi)) if inclusive else (c < _ntz_literal(hi))
    cond = (c >= _ntz_literal(lo)) & upper
    if partition_col in corrections.columns:
        day = F.col(partition_col)
        cond = cond & (day >= F.lit(lo.date())) & (day <= F.lit(hi.date()))
    return corrections.filter(cond)


def iso_instant(ts: Column) -> Column:
    """UTC ISO-8601 text with ``Z``: milliseconds, or microseconds when they are not zero."""
    micro = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(micro.endswith(F.lit("000")), F.substring(micro, 1, 23)).otherwise(micro), F.lit("Z")))


def export_projection(corrections: DataFrame) -> DataFrame:
    """The nine export columns as text, array joined by ``;`` (lossy for ``;`` in an element). An instant is given as it was
    sent where the rows carry that text (``created_at_sent``), else rendered."""
    rendered = iso_instant(F.col("created_at"))
    created = F.coalesce("created_at_sent", rendered) if "created_at_sent" in corrections.columns else rendered
    return corrections.select(
        F.col("id").cast("string").alias("id"),
        "skill_name",
        "working_directory",
        F.array_join("tech_stack", ";").alias("tech_stack"),
        "ai_output",
        "user_correction_input",
        js_number_text(F.col("classification_confidence")).alias("classification_confidence"),
        F.col("needs_batch_review").cast("string").alias("needs_batch_review"),
        created.alias("created_at"),
    )


def csv_lines(rows: DataFrame) -> DataFrame:
    """K2: (id, line) for every row; ``line`` is the CSV row text of the export columns."""
    p = export_projection(rows).withColumn("_row_id", F.col("id").cast("long"))
    return p.select(F.col("_row_id").alias("id"), csv_line([F.col(c) for c in EXPORT_COLUMNS]).alias("line"))


def export_lines(corrections: DataFrame, date_from: str, date_to: str) -> DataFrame:
    """P1 + P2 + K2: (id, line) for the corrections of a date range."""
    return csv_lines(in_date_range(corrections, date_from, date_to))


def csv_header(columns: list[str] | None = None) -> str:
    return ",".join(columns or EXPORT_COLUMNS)


def tech_stack_json(tech: Column) -> Column:
    """P5: the array as JSON text (``JSON.stringify`` form)."""
    return F.to_json(tech)

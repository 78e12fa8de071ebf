"""Display text: HTML escape (F2), rate label (F3), status label (F4); JavaScript white space."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import floor_div


def html_escape(c: Column) -> Column:
    """``&`` first, then ``<`` ``>`` ``"`` ``'``; NULL becomes empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(ent))
    return out


def rate_label(corrections: Column, invocations: Column) -> Column:
    """``rate * 100`` with one decimal and ``%``, where rate is a DOUBLE.

    The one-decimal number nearest to the exact value of the DOUBLE is taken, the larger one on a tie. The
    fraction of a DOUBLE, scaled by 2^62, is an exact integer (fractions under 2^-10 round to 0.0 anyway), so the
    comparison with the tie is done in DECIMAL. No invocations gives ``0.0%``.
    """
    inv = invocations.cast("long")
    rate = corrections.cast("double") / F.when(inv == 0, F.lit(1.0)).otherwise(inv.cast("double"))
    x = rate * F.lit(100.0)
    whole = F.floor(x).cast("long")
    scale = F.lit(1 << 62).cast("decimal(20,0)")
    tenths = ((x - whole.cast("double")) * F.lit(float(1 << 62))).cast("long").cast("decimal(20,0)") * F.lit(10).cast("decimal(2,0)")
    q = (tenths - F.pmod(tenths, scale)) / scale
    up = F.pmod(tenths, scale) * 2 >= scale
    n = whole * 10 + q.cast("long") + F.when(up, 1).otherwise(0)
    label = F.concat(floor_div(n, 10).cast("string"), F.lit("."), F.pmod(n, F.lit(10)).cast("string"), F.lit("%"))
    return F.when(inv == 0, F.lit("0.0%")).otherwise(label)


# Space characters of JavaScript's ``\s`` and ``trim`` (fixed values).
JS_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def js_trim(c: Column) -> Column:
    """Trim all white space at both ends, as JavaScript does (``trim`` takes blanks only)."""
    return F.regexp_replace(c, rf"^{JS_SPACE}+|{JS_SPACE}+\z", "")


# Fixed display labels of the merge-request status (English forms).
STATUS_LABELS = {"merged": "Merged", "closed": "Closed", "open": "Open"}


def status_label(status: Column, labels: dict | None = None) -> Column:
    """merged / closed / anything else shows as open."""
    lab = labels or STATUS_LABELS
    return (F.when(status == "merged", F.lit(lab["merged"]))
            .when(status == "closed", F.lit(lab["closed"]))
            .otherwise(F.lit(lab["open"])))

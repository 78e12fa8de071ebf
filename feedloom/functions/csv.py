"""CSV text: cell escaping (F1), JavaScript number text, CSV line (K2)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def js_number_text(x: Column) -> Column:
    """A double as JavaScript's ``String(number)`` writes it.

    Integers print without ``.0``; plain notation for 1e-6 <= |x| < 1e21,
    exponent form ``1.5e-7`` / ``1e+21`` outside. Java's own text (``1.0E-4``)
    is rewritten by moving the decimal point.
    """
    java = x.cast("string")
    mant = F.regexp_extract(java, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", 0)
    sign = F.regexp_extract(java, r"^(-?)[0-9]", 1)
    lead = F.regexp_extract(java, r"^-?([0-9])\.", 1)
    frac = F.regexp_replace(F.regexp_extract(java, r"\.([0-9]+)E", 1), "0+$", "")
    exp = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.concat(lead, frac)
    # 1e-6 <= |x| < 1e-3: 0.000ddd
    small_plain = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits)
    # |x| < 1e-6: d.ddde-7
    small_exp = F.concat(sign, lead, F.when(F.length(frac) > 0, F.concat(F.lit("."), frac)).otherwise(""),
                         F.lit("e"), exp.cast("string"))
    # 1e7 <= |x| < 1e21, not an integer: move the point right
    big_plain = F.concat(sign, lead, F.substr(frac, F.lit(1), exp), F.lit("."),
                         F.substr(frac, exp + 1))
    big_exp = F.concat(sign, lead, F.when(F.length(frac) > 0, F.concat(F.lit("."), frac)).otherwise(""),
                       F.lit("e+"), exp.cast("string"))
    is_int = (x == F.floor(x)) & (F.abs(x) < F.lit(1e21))
    return (
        F.when(x.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(x), F.lit("NaN"))
        .when(x == F.lit(float("inf")), F.lit("Infinity"))
        .when(x == F.lit(float("-inf")), F.lit("-Infinity"))
        .when(is_int, x.cast("decimal(38,0)").cast("string"))
        .when(mant == "", java)
        .when(exp >= 21, big_exp)
        .when(exp > 0, big_plain)
        .when(exp >= -6, small_plain)
        .otherwise(small_exp)
    )


def csv_cell(text: Column) -> Column:
    """NULL -> empty; quoted when it holds , " LF or CR; quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text), F.lit(""))


def csv_line(cells: list[Column]) -> Column:
    """K2: escaped cells joined by commas (NULL cells are empty, never skipped)."""
    return F.concat_ws(",", *[csv_cell(c) for c in cells])

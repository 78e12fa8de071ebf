"""Array building without lambda functions.

Higher-order functions (``filter``, ``transform``, ``forall``) are evaluated
without whole-stage code generation; in a wide validation projection that also
disables common-subexpression elimination. These helpers use ``flatten`` /
``sort_array`` / ``array_position`` instead, which are code-generated.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def compact(items: list[tuple[Column, Column]], element_type: str) -> Column:
    """``[value for cond, value in items if cond]`` as one array column."""
    empty = F.array().cast(f"array<{element_type}>")
    return F.flatten(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.array(val)).otherwise(empty)
                               for cond, val in items]))


def has_null_element(arr: Column) -> Column:
    """True when a non-empty array holds a NULL (``sort_array`` puts NULLs first)."""
    return F.coalesce((F.size(arr) > 0) & F.element_at(F.sort_array(arr, True), 1).isNull(), F.lit(False))


def all_nonempty_strings(arr: Column) -> Column:
    """Every element is a non-NULL, non-empty string (true for an empty array)."""
    return F.coalesce(~has_null_element(arr) & (F.array_position(arr, "") == 0), F.lit(False))


def floor_div(c: Column, divisor: int | Column) -> Column:
    """Exact integer floor division of BIGINTs (no trip through DOUBLE, which loses
    precision above 2**53): ``(c - pmod(c, d)) div d``."""
    d = divisor if isinstance(divisor, Column) else F.lit(int(divisor)).cast("long")
    c = c.cast("long")
    return F.call_function("div", c - F.pmod(c, d), d).cast("long")


def search(array: Column, key: Column, most: int) -> Column:
    """The number of entries of an ascending array that are <= ``key`` (0 for a NULL array or key): a binary search in
    log2(``most``) steps. ``most``: the most entries an array may have."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(int(most).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at))

"""Iteration calendar (F16): slot of a day and its type."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from .arrays import floor_div

# The documented defaults, X days per slot and a major every Y slots.
DEFAULT_INTERVAL_DAYS = 7
DEFAULT_MAJOR_EVERY = 4


def iteration_slot(ts: Column, anchor: dt.date, interval_days: int = DEFAULT_INTERVAL_DAYS) -> Column:
    """Slot n covers days [(n-1)X, nX) counted from the anchor date."""
    days = F.datediff(ts.cast("date"), F.lit(anchor))
    return floor_div(days, interval_days) + 1


def iteration_type(slot: Column, major_every: int = DEFAULT_MAJOR_EVERY) -> Column:
    """Major when slot % Y == 0, else minor."""
    return F.when(F.pmod(slot, F.lit(major_every)) == 0, F.lit("major")).otherwise(F.lit("minor"))


def major_slot(slot: Column, major_every: int = DEFAULT_MAJOR_EVERY) -> Column:
    """The major slot whose window holds ``slot``: slots (k-1)Y+1 .. kY."""
    return (F.ceil(slot / F.lit(major_every)) * major_every).cast("long")

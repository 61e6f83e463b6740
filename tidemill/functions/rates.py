"""Counts and rates with the rounding of the reports: half to even, zero where nothing was counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    return F.coalesce(F.bround(F.try_divide(part.cast("double"), whole.cast("double")), places), F.lit(0.0))


def mean(value: Column, places: int = 3) -> Column:
    return F.coalesce(F.bround(F.avg(value), places), F.lit(0.0))


def share_of(condition: Column, among: Column | None = None, places: int = 4) -> Column:
    """Share of rows (or of those ``among`` holds for) that meet the condition."""
    among = F.lit(True) if among is None else among
    return rate(F.count_if(among & condition), F.count_if(among), places)

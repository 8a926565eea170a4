"""Rounding, ratios and bands as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity, also below zero."""
    scale = 10**digits
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale) if digits else F.floor(x + F.lit(0.5))


def per_thousand(part: Column, whole: Column) -> Column:
    """part per 1000 of whole to one digit; 0 where there is no whole."""
    return F.when(whole > 0, round_half_up(part * F.lit(1000.0) / whole, 1)).otherwise(F.lit(0.0))


def prevalence(affected: Column, total: Column) -> Column:
    """none, rare (to 1/5), occasional (to 1/2), common (to 4/5) or pervasive."""
    share = affected / total
    return (
        F.when((affected == 0) | (total == 0), "none").when(share <= 0.2, "rare").when(share <= 0.5, "occasional").when(share <= 0.8, "common").otherwise("pervasive")
    )


def frequency_band(rate: Column) -> Column:
    """none, occasional (under 5 per 1000), noticeable (under 15) or frequent."""
    return F.when(rate <= 0, "none").when(rate < 5, "occasional").when(rate < 15, "noticeable").otherwise("frequent")


def overlap_share(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the overlap by the length of the shorter interval, which counts as 1 at least."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return both / F.least(F.greatest(F.lit(1), a_end - a_start), F.greatest(F.lit(1), b_end - b_start))


def count_form(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic plural form that goes with a number."""
    return (
        F.when((n % 100).between(11, 14), many).when(n % 10 == 1, one).when((n % 10).between(2, 4), few).otherwise(many)
    )

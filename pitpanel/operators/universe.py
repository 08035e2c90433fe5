"""Universes: which names may be held on a date. Every filter is a condition; the universe is their conjunction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import percent_rank
from .timeseries import rolling

#: Altman's Z below which a name counts as distressed.
DISTRESS = 1.81


@dataclass(frozen=True)
class Universe:
    """Limits of a universe; None leaves a filter out."""

    least_price: float | None = None
    least_traded: float | None = None
    least_mcap: float | None = None
    most_mcap: float | None = None
    small_share: float | None = None
    sectors: tuple[str, ...] | None = None
    without_sectors: tuple[str, ...] = ()
    without_locations: str | None = None
    without_names: str | None = None
    profitable: bool = False
    profitable_year: bool = False
    without_distress: bool = False

    def __post_init__(self):
        if self.least_mcap is not None and self.most_mcap is not None and self.least_mcap > self.most_mcap:
            raise ValueError("least_mcap is above most_mcap")


def traded(days: int = 20, least: int = 5) -> Column:
    return rolling(F.col("volume") * F.col("close"), days, "mean", least)


def members(panel: DataFrame, limits: Universe) -> DataFrame:
    """The rows of panel (prices joined with descriptions and as-of filings) in the universe. NULL fails, but for distress."""
    rows = panel
    keep = F.lit(True)
    if limits.least_price is not None:
        keep = keep & (F.coalesce("closeunadj", "close") >= limits.least_price) if "closeunadj" in panel.columns else keep & (F.col("close") >= limits.least_price)
    if limits.least_traded is not None:
        rows = rows.withColumn("__adv", traded())
        keep = keep & (F.col("__adv") >= limits.least_traded)
    if limits.least_mcap is not None:
        keep = keep & (F.col("mcap") >= limits.least_mcap)
    if limits.most_mcap is not None:
        keep = keep & (F.col("mcap") <= limits.most_mcap)
    if limits.small_share is not None:
        rows = rows.withColumn("__small", percent_rank(F.col("mcap"), "date"))
        keep = keep & (F.col("__small") <= limits.small_share)
    if limits.sectors is not None:
        keep = keep & F.col("sector").isin(*limits.sectors)
    if limits.without_sectors:
        keep = keep & ~F.coalesce(F.col("sector").isin(*limits.without_sectors), F.lit(False))
    if limits.without_locations:
        keep = keep & ~F.coalesce(F.col("location").rlike(f"(?i){limits.without_locations}"), F.lit(False))
    if limits.without_names:
        keep = keep & ~F.coalesce(F.col("name").rlike(limits.without_names), F.lit(False))
    if limits.profitable:
        keep = keep & (F.col("netinc") > 0)
    if limits.profitable_year:
        keep = keep & (F.col("netinc_ttm") > 0)
    if limits.without_distress:
        keep = keep & F.coalesce(F.col("altman_z") >= DISTRESS, F.lit(True))
    return rows.filter(keep).select(*panel.columns)


def industry_mask(sector: Column, industry: Column, chosen: dict[str, tuple[str, tuple[str, ...]]]) -> Column:
    """Any of the chosen groups: its sector, and one of its words in the industry (no words: the whole sector)."""
    out = F.lit(False)
    for group, words in chosen.values():
        hit = sector == group
        out = out | (hit & industry.rlike("(?i)" + "|".join(words)) if words else hit)
    return out

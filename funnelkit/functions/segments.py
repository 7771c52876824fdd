"""Segment predicate for the dashboard filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def segment_filter(regions: Iterable[str] | None = None,
                   channels: Iterable[str] | None = None,
                   region_col: str = "region",
                   channel_col: str = "channel") -> Column:
    """``region IN (...) AND channel IN (...)``; an empty list means no limit.

    Values are literals of the Column API, so quotes in them need no escaping.
    A NULL region or channel never passes a non-empty list.
    """
    cond = F.lit(True)
    regions = list(regions or [])
    channels = list(channels or [])
    if regions:
        cond = cond & F.col(region_col).isin(regions)
    if channels:
        cond = cond & F.col(channel_col).isin(channels)
    return cond

"""Lenient date parsing and ISO text, without session time-zone effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelkit.sources.schemas import DATE_FORMAT, TIMESTAMP_FORMAT


#: layouts that inference knows; on equal votes the earlier one is tried first
LAYOUTS = (
    TIMESTAMP_FORMAT, DATE_FORMAT, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd",
    "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "M/d/yyyy",
    "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "d/M/yyyy",
    "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy",
    "MMM d, yyyy", "d MMM yyyy",
)
#: stands for "the layouts that the column's own values vote for"
INFER = "infer"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(text: str | Column, fmt: str | Sequence[str] = TIMESTAMP_FORMAT) -> Column:
    """Text -> TIMESTAMP_NTZ; the first layout of ``fmt`` that fits counts, none gives NULL.

    ``try_to_timestamp`` decides validity (it never raises); the value comes
    from ``to_timestamp_ntz``, which parses without a time zone, so no value
    moves across a daylight-saving gap of the session zone. The CASE keeps the
    strict parser from ever seeing invalid text.
    """
    text = _col(text)

    def one(layout: str) -> Column:
        ok = F.try_to_timestamp(text, F.lit(layout)).isNotNull()
        return F.when(ok, F.to_timestamp_ntz(text, F.lit(layout)))

    return F.coalesce(*map(one, [fmt] if isinstance(fmt, str) else fmt))


def parse_date(text: str | Column, fmt: str | Sequence[str] = DATE_FORMAT) -> Column:
    """Text -> DATE; the first layout of ``fmt`` that fits counts, none gives NULL."""
    return parse_timestamp(text, fmt).cast("date")


def iso_text(value: str | Column, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """DATE / TIMESTAMP -> text in ``fmt`` (NULL stays NULL)."""
    return F.date_format(_col(value), fmt)

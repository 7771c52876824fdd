"""Report text: money, counts, percentages, Markdown rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def concat_text(*parts: str | Column) -> Column:
    """CONCAT that skips NULL parts (as the SQL engines of reports do)."""
    return F.concat_ws("", *[_col(p) for p in parts])


def currency_text(value: str | Column, decimals: int = 2) -> Column:
    """``$1,234.50``; NULL prints as ``$`` alone."""
    return concat_text(F.lit("$"), F.format_number(_col(value), decimals))


def integer_text(value: str | Column) -> Column:
    """``1,234``."""
    return F.format_number(_col(value), 0)


def pct_text(value: str | Column, decimals: int = 1) -> Column:
    """``12.3%`` for a value rounded to ``decimals``; NULL prints as ``%`` alone.

    Plain positional digits at every magnitude (a cast would print 1.0E7).
    """
    value = _col(value)
    digits = F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value))
    return concat_text(digits, F.lit("%"))


def cell_text(value: str | Column, numeric: bool = False) -> Column:
    """Text of a table cell; a missing value prints as ``nan`` or ``None``."""
    return F.coalesce(_col(value).cast("string"),
                      F.lit("nan" if numeric else "None"))


def markdown_row(*cells: Column) -> Column:
    """``| a | b | c |`` from already formatted text cells."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))

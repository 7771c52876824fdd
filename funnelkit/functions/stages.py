"""Funnel stage vocabulary as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from funnelkit.sources.schemas import STAGES


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stage_order(stage: str | Column = "order_stage") -> Column:
    """Step number 1..4 of a known stage, NULL for anything else (bigint)."""
    stage = _col(stage)
    expr = None
    for step, name in enumerate(STAGES, start=1):
        expr = (F.when(stage == name, F.lit(step)) if expr is None
                else expr.when(stage == name, F.lit(step)))
    return expr.cast("bigint")


def is_known_stage(stage: str | Column = "order_stage") -> Column:
    """True for the four known stages; False (never NULL) otherwise."""
    return F.coalesce(_col(stage).isin(list(STAGES)), F.lit(False))

"""Column rules of the data dictionary, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantlens.functions.stats import col_
from plantlens.schema import LUBRICATION_BANDS, SHIFTS


def lubrication_band(oil: str | Column = "oil_level") -> Column:
    """Good >= 70, Low in [40, 70), Critical < 40; NULL oil -> NULL."""
    oil = col_(oil)
    expr = None
    for name, lo in LUBRICATION_BANDS:
        if lo is None:
            expr = expr.when(oil.isNotNull(), F.lit(name))
        elif expr is None:
            expr = F.when(oil >= lo, F.lit(name))
        else:
            expr = expr.when(oil >= lo, F.lit(name))
    return expr


def shift_of_hour(hour: str | Column) -> Column:
    """Shift name of an hour 0-23 (half-open: 06-14, 14-22, 22-06)."""
    h = col_(hour)
    expr = None
    for name, start, end in SHIFTS:
        cond = (h >= start) & (h < end) if start < end else (h >= start) | (h < end)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def shift_of(ts: str | Column) -> Column:
    return shift_of_hour(F.hour(col_(ts)))


def calendar(ts: str | Column) -> dict[str, Column]:
    """hour, day_of_week (Monday = 0) and weekend flag of a timestamp."""
    t = col_(ts)
    dow = F.weekday(t)
    return {"hour": F.hour(t), "day_of_week": dow,
            "is_weekend": F.when(dow >= 5, 1).otherwise(0)}

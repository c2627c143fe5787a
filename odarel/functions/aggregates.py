"""Aggregate methods, with SQL's treatment of nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def aggregate(method: str, column: Column | None) -> Column:
    """``column`` None counts rows."""
    if method == "count":
        return F.count(F.lit(1) if column is None else column)
    if column is None:
        column = F.lit(1)
    return {"sum": F.sum, "average": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "countdistinct": F.count_distinct}[method](column)

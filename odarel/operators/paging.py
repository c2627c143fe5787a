"""Keyset paging: what comes after a row in a sort order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odarel.errors import ODataError
from odarel.plans.ast import Order


def value_of(value, kind: T.DataType | None) -> Column:
    if value is None:
        return F.lit(None)
    if isinstance(kind, T.TimestampType) and isinstance(value, str):
        return F.lit(value if "+" in value or value.endswith("Z") else f"{value}+00:00").cast(kind)
    return F.lit(value).cast(kind) if kind is not None else F.lit(value)


def after(scope, orders: list[Order], values: list) -> Column:
    """Rows that sort after ``values``: nulls last ascending, first descending.

    ``(k1 beyond v1) or (k1 = v1 and k2 beyond v2) or ...``
    """
    if len(values) != len(orders):
        raise ODataError("the continuation doesn't fit the order")
    terms: list[Column] = []
    same: list[Column] = []
    for order, value in zip(orders, values, strict=True):
        column, kind = scope.compiler.typed(order.expr)
        v = value_of(value, kind)
        if order.desc:
            beyond = column.isNotNull() if value is None else column < v
        else:
            beyond = F.lit(False) if value is None else (column > v) | column.isNull()
        terms.append(reduce(lambda a, b: a & b, [*same, F.coalesce(beyond, F.lit(False))]))
        same.append(column.eqNullSafe(v))
    return reduce(lambda a, b: a | b, terms)

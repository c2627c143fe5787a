"""Sort orders: nulls last ascending and first descending, keys as the tie-break."""

from __future__ import annotations

from pyspark.sql import Column

from odarel.plans.ast import Order, Path


def sort_columns(scope, orders: list[Order], keys: list[str] = ()) -> list[Column]:
    out, named = [], set()
    for o in orders:
        column = scope.compiler.column(o.expr)
        out.append(column.desc_nulls_first() if o.desc else column.asc_nulls_last())
        if isinstance(o.expr, Path):
            named.add(o.expr.name)
    return out + [scope.compiler.column(Path(tuple(k.split("/")))).asc_nulls_last() for k in keys if k not in named]

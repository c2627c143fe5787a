"""Change feeds: rows changed since a mark, and rows that are gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odarel.catalog import Catalog
from odarel.errors import ODataError
from odarel.functions.scalar import literal
from odarel.operators.paging import after
from odarel.operators.scope import EntityScope
from odarel.plans.ast import Lit, Order, Path


def changed(scope: EntityScope, last, keys: list | None = None) -> Column:
    """``delta field > last or (delta field = last and keys > keys)``."""
    field = scope.entity.delta
    if field is None:
        raise ODataError(f"{scope.entity.name} has no delta field")
    column, kind = scope.resolve(Path((field,)))
    mark = literal(Lit(last, "datetime"), kind) if isinstance(last, str) else F.lit(last).cast(kind)
    if keys is None:
        return column > mark
    orders = [Order(Path((k,))) for k in scope.entity.keys]
    return (column > mark) | ((column == mark) & after(scope, orders, keys))


def changed_since(catalog: Catalog, name: str, last, keys: list | None = None) -> DataFrame:
    scope = EntityScope.of(catalog, name)
    return scope.df.filter(changed(scope, last, keys))


def high_mark(scope: EntityScope) -> list[Column]:
    """Aggregates for the mark of the next token: the greatest delta value and, with it, the greatest keys."""
    parts = [scope.entity.delta, *scope.entity.keys]
    return [F.max(F.struct(*parts)).alias("mark")]


def tombstones(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``before`` whose keys are no longer there, with the reason; null keys match null keys."""
    condition = None
    left, right = before.alias("b"), now.select(*keys).alias("n")
    for k in keys:
        term = F.col(f"b.{k}").eqNullSafe(F.col(f"n.{k}"))
        condition = term if condition is None else condition & term
    return left.join(right, condition, "left_anti").withColumn("@removed", F.lit("deleted"))


def bucket_changes(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate delta: groups that are new or have other values, and those gone with their last values."""
    fresh = now.exceptAll(before.select(*now.columns)).withColumn("@removed", F.lit(None).cast("string"))
    return fresh.unionByName(tombstones(before.select(*now.columns), now, keys))

"""A collection query as one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from odarel.catalog import Catalog
from odarel.errors import ODataError
from odarel.operators.apply import Pipeline, run_apply
from odarel.operators.expand import chosen, expand
from odarel.operators.ordering import sort_columns
from odarel.operators.scope import EntityScope, FlatScope, quoted
from odarel.operators.search import search
from odarel.plans.ast import Options, Order, Path


@dataclass
class Planned:
    """Rows before paging, in a scope; the order that pages follow; and how to finish a page."""

    scope: EntityScope | FlatScope
    orders: list[Order]
    options: Options
    pipeline: Pipeline | None = None
    search_mode: str = "annotated"

    def sorted(self) -> list:
        return sort_columns(self.scope, self.orders)

    def paged(self, *, always: bool = False) -> DataFrame:
        """Ordered and cut by $skip and $top; an order without a cut is kept, too."""
        o = self.options
        ordered = (o.orderby or o.top is not None or o.skip or always) and self.orders
        by = self.sorted() if ordered else []  # may join what it names
        df = self.scope.df.orderBy(*by) if by else self.scope.df
        if o.skip:
            df = df.offset(o.skip)
        return df if o.top is None else df.limit(o.top)

    def shown(self, df: DataFrame) -> DataFrame:
        """With $expand and $select."""
        if self.pipeline is not None:
            self.pipeline.scope.df = df
            return self.pipeline.frame()
        scope: EntityScope = self.scope
        entity, o = scope.entity, self.options
        if o.expand:
            df = expand(scope.catalog, entity, df, o.expand, few=o.top is not None, search_mode=self.search_mode)
        names = chosen(entity, scope.names(), o)
        expanded = list(dict.fromkeys(x.path[0] for x in o.expand))
        return df.select(*[quoted(c) for c in dict.fromkeys([*names, *expanded])])


def plan(catalog: Catalog, name: str, options: Options, *, search_mode: str = "annotated", base: DataFrame | None = None) -> Planned:
    entity = catalog.get(name)
    scope = EntityScope(catalog, entity, catalog.frame(entity.name) if base is None else base)
    if options.search is not None:
        scope.df_filter(search(scope, options.search, search_mode))
    if options.filter is not None:
        scope.filter(options.filter)
    if options.apply is not None:
        if options.expand:
            raise ODataError("$expand doesn't go with $apply")
        done = run_apply(scope, options.apply)
        if options.select:
            missing = [c for c in options.select if c not in done.scope.df.columns]
            if missing:
                raise ODataError(f"unknown property {missing[0]!r} after $apply")
            done.scope.df = done.scope.df.select(*[quoted(c) for c in options.select])
            done.keys = [k for k in done.keys if k in options.select]
            done.scope = FlatScope(done.scope.df)
        orders = options.orderby or done.default_order()
        orders = orders + [o for o in (Order(Path(tuple(k.split("/")))) for k in done.keys) if o.expr not in [x.expr for x in orders]]
        return Planned(done.scope, orders, options, done)
    for tree, alias in options.compute:
        if alias in scope.names():
            raise ODataError(f"alias {alias!r} of $compute is a property")
        column, kind = scope.compiler.typed(tree)
        scope.df = scope.df.withColumn(alias, column)
        scope.types[alias] = kind if kind is not None else scope.df.schema[alias].dataType
    keys = [Order(Path((k,))) for k in entity.keys]
    named = [o.expr for o in options.orderby]
    return Planned(scope, options.orderby + [k for k in keys if k.expr not in named], options, search_mode=search_mode)


def query(catalog: Catalog, name: str, options: Options, **more) -> DataFrame:
    done = plan(catalog, name, options, **more)
    return done.shown(done.paged())

"""$apply pipelines.

A stage runs from one grouping to the next. Inside it the order is grouping,
filter, orderby, skip, top, wherever they are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odarel.errors import ODataError
from odarel.functions.aggregates import aggregate
from odarel.operators.ordering import sort_columns
from odarel.operators.scope import EntityScope, FlatScope, quoted
from odarel.plans.ast import Concat, Filter, GroupBy, Order, OrderBy, Path, Skip, Top, walk

BRANCH = "__branch"


class Pipeline:
    """A scope going through transformations; ``order`` is the order its rows are in."""

    def __init__(self, scope: EntityScope | FlatScope, keys: list[str]):
        self.scope, self.keys, self.order = scope, keys, []
        self.has: dict[str, set[int]] | None = None  # after a union: which branches have a column

    def run(self, steps) -> Pipeline:
        stage: list = []
        for step in steps:
            if isinstance(step, (GroupBy, Concat)):
                self._finish(stage)
                stage = []
                self._group(step) if isinstance(step, GroupBy) else self._concat(step)
            else:
                stage.append(step)
        self._finish(stage)
        return self

    # one stage

    def _finish(self, stage: list) -> None:
        for kind in (OrderBy, Skip, Top):
            if sum(isinstance(x, kind) for x in stage) > 1:
                raise ODataError(f"{kind.__name__.lower()} stands twice in a stage")
        for step in stage:
            if isinstance(step, Filter):
                self._filter(step.pred)
        orders = next((list(x.orders) for x in stage if isinstance(x, OrderBy)), None)
        skip = next((x.n for x in stage if isinstance(x, Skip)), 0)
        top = next((x.n for x in stage if isinstance(x, Top)), None)
        if orders is not None:
            self.order = orders
        if orders is not None or skip or top is not None:
            columns = sort_columns(self.scope, self.order, self.keys)
            if self.has is not None:
                columns = [F.col(BRANCH).asc(), *columns]
            if columns:
                self.scope.df = self.scope.df.orderBy(*columns)
        if skip:
            self.scope.df = self.scope.df.offset(skip)
        if top is not None:
            self.scope.df = self.scope.df.limit(top)

    def _filter(self, pred) -> None:
        if self.has is None:
            self.scope.filter(pred)
            return
        named = {x.name for x in walk(pred) if isinstance(x, Path)}
        every = set().union(*self.has.values())
        lacking = sorted({b for b in every for n in named if b not in self.has.get(n, set())})
        truth = self.scope.compiler.column(pred)
        self.scope.df = self.scope.df.filter(truth | F.col(BRANCH).isin(lacking) if lacking else truth)

    # groupings

    def _group(self, step: GroupBy) -> None:
        if self.has is not None:
            self.scope, self.has = FlatScope(self.scope.df.drop(BRANCH)), None
        if isinstance(self.scope, EntityScope):
            self.scope.fan_out = True
        scope = self.scope
        keys = [(k.name, scope.compiler.column(k)) for k in step.keys]
        names = [n for n, _ in keys] + [a.alias for a in step.aggregates]
        if len(set(names)) < len(names):
            raise ODataError("a key or alias is used twice")
        values = [aggregate(a.method, None if a.expr is None else scope.compiler.column(a.expr)).alias(a.alias) for a in step.aggregates]
        grouped = scope.df.groupBy(*[c.alias(n) for n, c in keys]) if keys else scope.df
        self.scope = FlatScope(grouped.agg(*values))
        self.keys, self.order = names, []

    def _concat(self, step: Concat) -> None:
        frames: list[DataFrame] = []
        has: dict[str, set[int]] = {}
        count = 0
        names: list[str] = []
        for branch in step.branches:
            part = Pipeline(self._copy(), list(self.keys)).run(branch)
            df = part.frame(keep_branch=True)
            own = part.has or {c: {0} for c in df.columns}
            inner = 1 + max((b for s in own.values() for b in s), default=0)
            for c, branches in own.items():
                has.setdefault(c, set()).update(count + b for b in branches)
            mark = F.col(BRANCH) + count if BRANCH in df.columns else F.lit(count)
            frames.append(df.withColumn(BRANCH, mark.cast("int")))
            names += [k for k in part.keys if k not in names]
            count += inner
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        self.scope, self.has, self.keys, self.order = FlatScope(out), has, [n for n in names if n in out.columns], []

    def _copy(self):
        s = self.scope
        if isinstance(s, FlatScope):
            return FlatScope(s.df.drop(BRANCH))
        copy = EntityScope(s.catalog, s.entity, s.df, s.prefix, fan_out=s.fan_out)
        copy.types, copy.joined = dict(s.types), dict(s.joined)
        return copy

    def frame(self, *, keep_branch: bool = False) -> DataFrame:
        """The rows; of an entity its own columns only."""
        df = self.scope.df
        if isinstance(self.scope, EntityScope):
            return df.select(*[quoted(c) for c in self.scope.names()])
        return df if keep_branch or BRANCH not in df.columns else df.drop(BRANCH)

    def default_order(self) -> list[Order]:
        """Group keys and then aliases, ascending."""
        return self.order or [Order(Path(tuple(k.split("/")))) for k in self.keys]


def run_apply(scope: EntityScope, steps) -> Pipeline:
    return Pipeline(scope, list(scope.entity.keys)).run(steps)

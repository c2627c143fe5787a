"""Names of a query: properties, structured paths, relations, quantifiers.

A scope holds a DataFrame whose columns carry the scope's prefix. A to-one
path is joined once, from the left, the first time it is named; its columns
are called ``relation/column``. Catalyst prunes what isn't used and picks the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odarel.catalog import Catalog, EntitySet, Relation
from odarel.errors import ODataError
from odarel.functions.scalar import Compiler
from odarel.plans.ast import Lambda, Logic, Path


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[quoted(c).alias(prefix + c) for c in df.columns])


def linked(catalog: Catalog, relation: Relation, prefix: str, link: str) -> DataFrame:
    """The relation's target rows, prefixed, with the source key's value in ``link``."""
    target = renamed(catalog.frame(relation.target), prefix)
    if relation.through is None:
        return target.withColumn(link, quoted(prefix + relation.target_key))
    bridge = catalog.frame(relation.through).select(quoted(relation.through_source).alias(link), quoted(relation.through_target).alias("__bridge"))
    return bridge.join(target, quoted("__bridge") == quoted(prefix + relation.target_key)).drop("__bridge")


class EntityScope:
    """Rows of an entity set, with whatever is joined to them."""

    def __init__(self, catalog: Catalog, entity: EntitySet, df: DataFrame, prefix: str = "", *, fan_out: bool = False, var: str | None = None):
        self.catalog, self.entity, self.df, self.prefix, self.fan_out, self.var = catalog, entity, df, prefix, fan_out, var
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.joined: dict[tuple[str, ...], EntitySet] = {}
        self.flags = 0
        self.compiler = Compiler(self.resolve, self.quantifier)

    @classmethod
    def of(cls, catalog: Catalog, name: str, **options) -> EntityScope:
        entity = catalog.get(name)
        return cls(catalog, entity, catalog.frame(entity.name), **options)

    def names(self) -> list[str]:
        return [c for c in self.catalog.frame(self.entity.name).columns]

    # paths

    def resolve(self, path: Path) -> tuple[Column, T.DataType | None]:
        parts = path.parts
        if self.var is not None:
            if parts[0] != self.var:
                raise ODataError(f"{path.name} needs the prefix {self.var}", code="lambda-alias-prefix-required")
            parts = parts[1:]
        entity, at = self.entity, 0
        while at < len(parts) and parts[at] in entity.relations and self.prefix + "/".join(parts[: at + 1]) not in self.types:
            at += 1
            entity = self._join(parts[:at])
        if at == len(parts):
            raise ODataError(f"{path.name} names a relation, not a property")
        prefix = self.prefix + "".join(f"{p}/" for p in parts[:at])
        name = prefix + parts[at]
        if name not in self.types:
            raise ODataError(f"unknown property {path.name!r} of {self.entity.name}")
        return self._inside(entity, parts[at], quoted(name), self.types[name], parts[at + 1 :], path)

    def _inside(self, entity: EntitySet, name: str, column: Column, kind: T.DataType, rest: tuple[str, ...], path: Path):
        """A structured path below a property: struct fields, or JSON text."""
        if rest and name in entity.json:
            declared = entity.json[name]
            if "/".join(rest) not in declared:
                raise ODataError(f"unknown structured path {path.name!r}")
            kind = T._parse_datatype_string(declared["/".join(rest)])
            return F.get_json_object(column, "$." + ".".join(rest)).try_cast(kind), kind
        for part in rest:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                raise ODataError(f"unknown structured path {path.name!r}")
            column, kind = column.getField(part), kind[part].dataType
        return column, kind

    def _join(self, path: tuple[str, ...]) -> EntitySet:
        if path in self.joined:
            return self.joined[path]
        limits = self.catalog.limits
        if len(path) > limits.path_depth:
            raise ODataError(f"paths are {limits.path_depth} relations long at most")
        if len(self.joined) >= limits.joins:
            raise ODataError(f"a query joins {limits.joins} relations at most", code="pushdown-join-count-exceeded")
        source = self._join(path[:-1]) if len(path) > 1 else self.entity
        relation = source.relations[path[-1]]
        if (relation.kind != "one" or relation.through) and not self.fan_out:
            raise ODataError(f"{'/'.join(path)} has many targets; use any or all")
        above = self.prefix + "".join(f"{p}/" for p in path[:-1])
        prefix = above + path[-1] + "/"
        link = f"__link {prefix}"
        target = linked(self.catalog, relation, prefix, link)
        self.df = self.df.join(target, quoted(above + relation.source_key) == quoted(link), "left").drop(link)
        self.types |= {f.name: f.dataType for f in self.df.schema.fields}
        self.joined[path] = self.catalog.get(relation.target)
        return self.joined[path]

    # quantifiers

    def _inner(self, node: Lambda) -> tuple[str, DataFrame]:
        """The outer column that links, and the inner link values which make ``any`` true or ``all`` false."""
        parts = node.path[1:] if self.var is not None and node.path[0] == self.var else node.path
        entity, at = self.entity, 0
        while at < len(parts) - 1 and parts[at] in entity.relations and entity.relations[parts[at]].kind == "one":
            at += 1
            entity = self._join(tuple(parts[:at]))
        if parts[at] not in entity.relations:
            raise ODataError(f"unknown relation {'/'.join(node.path)!r} of {self.entity.name}")
        relation = entity.relations[parts[at]]
        outer = self.prefix + "".join(f"{p}/" for p in parts[:at]) + relation.source_key
        prefix, link = f"{self.prefix}{node.var or '_'}#", "__link"
        inner = linked(self.catalog, relation, prefix, link)
        for step in parts[at + 1 :]:
            entity = self.catalog.get(relation.target)
            if step not in entity.relations:
                raise ODataError(f"unknown relation {'/'.join(node.path)!r}")
            relation = entity.relations[step]
            further = linked(self.catalog, relation, f"{prefix}{step}/", "__next")
            inner = inner.join(further, quoted(prefix + relation.source_key) == quoted("__next")).drop("__next")
            prefix = f"{prefix}{step}/"
        if node.pred is not None:
            scope = EntityScope(self.catalog, self.catalog.get(relation.target), inner, prefix, var=node.var)
            truth = scope.compiler.column(node.pred)
            inner = scope.df.filter(truth if node.op == "any" else ~F.coalesce(truth, F.lit(False)))
        return outer, inner.select(link)

    def quantifier(self, node: Lambda) -> Column:
        """Truth as a column: from a left join to the distinct links, so that it may stand under or."""
        outer, hits = self._inner(node)
        self.flags += 1
        key, flag = f"__key{self.flags} {self.prefix}", f"__flag{self.flags} {self.prefix}"
        hits = hits.distinct().select(quoted("__link").alias(key), F.lit(True).alias(flag))
        self.df = self.df.join(hits, quoted(outer) == quoted(key), "left").drop(key)
        found = F.coalesce(quoted(flag), F.lit(False))
        return found if node.op == "any" else ~found

    # filters

    def filter(self, tree) -> None:
        """Keep the rows for which the tree is true; quantifiers that stand alone become semi- and anti-joins."""
        terms = list(tree.terms) if isinstance(tree, Logic) and tree.op == "and" else [tree]
        plain = [x for x in terms if not isinstance(x, Lambda)]
        if plain:
            self.df_filter(reduce(lambda a, b: a & b, [self.compiler.column(x) for x in plain]))
        for node in terms:
            if isinstance(node, Lambda):
                outer, hits = self._inner(node)
                kind = "left_semi" if node.op == "any" else "left_anti"
                self.df = self.df.join(hits, quoted(outer) == quoted("__link"), kind)

    def df_filter(self, condition: Column) -> None:
        self.df = self.df.filter(condition)


class FlatScope:
    """Columns as they are: the output of an aggregation or a union."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.compiler = Compiler(self.resolve)

    def resolve(self, path: Path) -> tuple[Column, T.DataType | None]:
        if path.name not in self.df.columns:
            raise ODataError(f"{path.name!r} isn't a key or alias of the stage before")
        return quoted(path.name), self.df.schema[path.name].dataType

    def filter(self, tree) -> None:
        self.df = self.df.filter(self.compiler.column(tree))

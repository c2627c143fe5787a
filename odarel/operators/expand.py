"""$expand: related rows as arrays and structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from odarel.catalog import Catalog, EntitySet
from odarel.errors import ODataError
from odarel.operators.ordering import sort_columns
from odarel.operators.scope import EntityScope, linked, quoted
from odarel.operators.search import search
from odarel.plans.ast import Expand, Options

LINK = "__link"


def _tree(items: list[Expand]) -> list[Expand]:
    """``a/b`` as b inside a; paths with a common start share it."""
    out: dict[str, Expand] = {}
    for item in items:
        head, rest = item.path[0], item.path[1:]
        options = item.options if not rest else Options(expand=[Expand(rest, item.options)])
        if head in out:
            old = out[head].options
            if rest:
                old.expand = old.expand + options.expand
                continue
            options.expand = options.expand + old.expand
        out[head] = Expand((head,), options)
    return list(out.values())


def expand(catalog: Catalog, entity: EntitySet, df: DataFrame, items: list[Expand], depth: int = 1, *, few: bool = False, search_mode: str = "annotated") -> DataFrame:
    """``df`` with a column per relation: an array (maybe empty) of structs, or a struct or null.

    Where ``df`` is a page and so ``few`` rows, only the rows that it leads to are ranked and grouped.
    """
    if depth > (most := catalog.limits.expand_depth):
        raise ODataError(f"$expand nests {most} deep at most")
    for item in _tree(items):
        name = item.path[0]
        if name not in entity.relations:
            raise ODataError(f"unknown relation {name!r} of {entity.name}")
        relation, options = entity.relations[name], item.options
        target = catalog.get(relation.target)
        scope = EntityScope(catalog, target, linked(catalog, relation, "", LINK))
        if few:
            wanted = df.select(quoted(relation.source_key).alias("__wanted")).distinct()
            scope.df = scope.df.join(wanted, quoted(LINK) == quoted("__wanted"), "left_semi")
        if options.search is not None:
            scope.df_filter(search(scope, options.search, search_mode))
        if options.filter is not None:
            scope.filter(options.filter)
        for tree, alias in options.compute:
            scope.df = scope.df.withColumn(alias, scope.compiler.column(tree))
        one = relation.kind == "one" and not relation.through
        sort = sort_columns(scope, options.orderby, list(target.keys))
        rows = scope.df
        if not one and (options.orderby or options.top is not None or options.skip):
            rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(LINK).orderBy(*sort)))
            low = options.skip or 0
            if low:
                rows = rows.filter(F.col("__nth") > low)
            if options.top is not None:
                rows = rows.filter(F.col("__nth") <= low + options.top)
        nested = list(options.expand)
        if options.levels > 1 and name in target.relations and target.relations[name].target == relation.target:
            deeper = Options(select=options.select, filter=options.filter, search=options.search, orderby=options.orderby, top=options.top, skip=options.skip, levels=options.levels - 1)
            nested.append(Expand((name,), deeper))
        if nested:
            rows = expand(catalog, target, rows, nested, depth + 1, few=few, search_mode=search_mode)
        shown = chosen(target, catalog.frame(target.name).columns, options) + [n.path[0] for n in _tree(nested)]
        body = F.struct(*[quoted(c).alias(c) for c in dict.fromkeys(shown)])
        key = f"__own {name}"
        if one:
            child = rows.select(quoted(LINK).alias(key), body.alias(name))
            df = df.join(child, quoted(relation.source_key) == quoted(key), "left").drop(key)
            continue
        order = F.col("__nth") if "__nth" in rows.columns else F.lit(0)
        packed = F.sort_array(F.collect_list(F.struct(order.alias("n"), *[F.col(f"__k{i}") for i, _ in enumerate(target.keys)], F.col("__row"))))
        plain = rows.select(quoted(LINK).alias(key), *(["__nth"] if "__nth" in rows.columns else []), *[quoted(k).alias(f"__k{i}") for i, k in enumerate(target.keys)], body.alias("__row"))
        child = plain.groupBy(key).agg(F.transform(packed, lambda x: x["__row"]).alias(name))
        df = df.join(child, quoted(relation.source_key) == quoted(key), "left").drop(key)
        df = df.withColumn(name, F.coalesce(quoted(name), F.array().cast(df.schema[name].dataType)))
    return df


def chosen(entity: EntitySet, columns: list[str], options: Options) -> list[str]:
    """Columns of $select and $compute, all without $select."""
    computed = [alias for _, alias in options.compute]
    if options.select is None:
        return [*columns, *[a for a in computed if a not in columns]]
    out = []
    for name in options.select:
        root = name.split("/")[0]
        if root in entity.relations:
            continue
        if root not in columns and root not in computed:
            raise ODataError(f"unknown property {name!r} of {entity.name}")
        out.append(root)
    return list(dict.fromkeys([*out, *computed]))

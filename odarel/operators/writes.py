"""Writes as transformations: a new table from the old one.

Tables are immutable DataFrames. Each function returns what the set holds
afterwards; the caller decides where to write it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odarel.catalog import Catalog, Relation
from odarel.errors import ODataError
from odarel.operators.scope import quoted

MAX_DEPTH = 10


def at_key(keys: tuple[str, ...], values: tuple) -> Column:
    if len(keys) != len(values):
        raise ODataError(f"the key has {len(keys)} parts")
    return reduce(lambda a, b: a & b, [quoted(k) == F.lit(v) for k, v in zip(keys, values, strict=True)])


def _row(df: DataFrame, values: dict) -> DataFrame:
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ODataError(f"unknown property {min(unknown)!r}")
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])


def insert(df: DataFrame, keys: tuple[str, ...], values: dict) -> DataFrame:
    if all(k in values for k in keys) and not df.filter(at_key(keys, tuple(values[k] for k in keys))).isEmpty():
        raise ODataError("the key is taken", 409)
    return df.unionByName(_row(df, values))


def patch(df: DataFrame, keys: tuple[str, ...], key: tuple, values: dict) -> DataFrame:
    """The same table with some columns of one row changed; a narrow projection, no shuffle."""
    unknown = set(values) - set(df.columns)
    if unknown:
        raise ODataError(f"unknown property {min(unknown)!r}")
    if any(k in values and values[k] != v for k, v in zip(keys, key, strict=True)):
        raise ODataError("a key can't be changed")
    hit = at_key(keys, key)
    return df.select(*[F.when(hit, F.lit(values[f.name]).cast(f.dataType)).otherwise(quoted(f.name)).alias(f.name) if f.name in values and f.name not in keys else quoted(f.name) for f in df.schema.fields])


def replace(df: DataFrame, keys: tuple[str, ...], key: tuple, values: dict) -> DataFrame:
    return patch(df, keys, key, {c: values.get(c) for c in df.columns if c not in keys})


def delete(df: DataFrame, keys: tuple[str, ...], key: tuple) -> DataFrame:
    return df.filter(~F.coalesce(at_key(keys, key), F.lit(False)))


def upsert(df: DataFrame, keys: tuple[str, ...], rows: DataFrame) -> DataFrame:
    """Many rows at once: those of ``rows`` take the place of equal keys."""
    return df.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*df.columns))


def delete_many(df: DataFrame, keys: tuple[str, ...], gone: DataFrame) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def deep_insert(catalog: Catalog, name: str, body: dict, depth: int = 1, *, changed: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables after inserting an entity with related ones nested in it: targets of to-one relations first, then itself, then its children."""
    if depth > MAX_DEPTH:
        raise ODataError(f"a graph nests {MAX_DEPTH} deep at most")
    changed = {} if changed is None else changed
    entity = catalog.get(name)
    own = {k: v for k, v in body.items() if k not in entity.relations}
    nested = {k: v for k, v in body.items() if k in entity.relations}
    for relation, value in ((entity.relations[k], v) for k, v in nested.items() if entity.relations[k].kind == "one"):
        deep_insert(catalog, relation.target, value, depth + 1, changed=changed)
        own.setdefault(relation.source_key, value.get(relation.target_key))
    frame = changed.get(entity.name, catalog.frame(entity.name))
    changed[entity.name] = insert(frame, entity.keys, own)
    for relation, values in ((entity.relations[k], v) for k, v in nested.items() if entity.relations[k].kind != "one"):
        for value in values:
            if relation.through:
                deep_insert(catalog, relation.target, value, depth + 1, changed=changed)
                bridge = catalog.get(relation.through)
                rows = changed.get(bridge.name, catalog.frame(bridge.name))
                changed[bridge.name] = rows.unionByName(_row(rows, {relation.through_source: own[relation.source_key], relation.through_target: value[relation.target_key]}))
            else:
                deep_insert(catalog, relation.target, {**value, relation.target_key: own[relation.source_key]}, depth + 1, changed=changed)
    return changed


def deep_update(catalog: Catalog, name: str, key: tuple, body: dict, depth: int = 1, *, changed: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Tables after changing an entity and changing or inserting the nested ones; none is deleted."""
    if depth > MAX_DEPTH:
        raise ODataError(f"a graph nests {MAX_DEPTH} deep at most")
    changed = {} if changed is None else changed
    entity = catalog.get(name)
    own = {k: v for k, v in body.items() if k not in entity.relations}
    frame = changed.get(entity.name, catalog.frame(entity.name))
    row = frame.filter(at_key(entity.keys, key)).first()
    if row is None:
        raise ODataError(f"{entity.name} has no such entity", 404)
    if own:
        changed[entity.name] = patch(frame, entity.keys, key, own)
    for relation, value in ((entity.relations[k], v) for k, v in body.items() if k in entity.relations):
        target = catalog.get(relation.target)
        for child in value if isinstance(value, list) else [value]:
            if relation.kind != "one" and not relation.through:
                child = {**child, relation.target_key: row[relation.source_key]}
            rows = changed.get(target.name, catalog.frame(target.name))
            own_key = tuple(child.get(k) for k in target.keys)
            if None not in own_key and not rows.filter(at_key(target.keys, own_key)).isEmpty():
                deep_update(catalog, target.name, own_key, child, depth + 1, changed=changed)
            else:
                deep_insert(catalog, target.name, child, depth + 1, changed=changed)
    return changed


def link(catalog: Catalog, name: str, key: tuple, relation_name: str, target_key: tuple | None) -> dict[str, DataFrame]:
    """Tables after setting (or, with None, clearing) a reference."""
    entity = catalog.get(name)
    relation = entity.relations.get(relation_name)
    if relation is None:
        raise ODataError(f"unknown relation {relation_name!r}", 404)
    source = catalog.frame(entity.name)
    if relation.kind == "one" and not relation.through:
        value = None
        if target_key is not None:
            target = catalog.get(relation.target)
            found = catalog.frame(target.name).filter(at_key(target.keys, target_key)).first()
            if found is None:
                raise ODataError("no such target", 404)
            value = found[relation.target_key]
        return {entity.name: patch(source, entity.keys, key, {relation.source_key: value})}
    row = source.filter(at_key(entity.keys, key)).first()
    if row is None:
        raise ODataError(f"{entity.name} has no such entity", 404)
    if target_key is None:
        raise ODataError("the target's key is needed")
    target = catalog.get(relation.target)
    if relation.through:
        bridge = catalog.get(relation.through)
        rows = catalog.frame(bridge.name)
        found = catalog.frame(target.name).filter(at_key(target.keys, target_key)).first()
        if found is None:
            raise ODataError("no such target", 404)
        return {bridge.name: rows.unionByName(_row(rows, {relation.through_source: row[relation.source_key], relation.through_target: found[relation.target_key]}))}
    return {target.name: patch(catalog.frame(target.name), target.keys, target_key, {relation.target_key: row[relation.source_key]})}


def unlink(catalog: Catalog, name: str, key: tuple, relation_name: str, target_key: tuple | None = None) -> dict[str, DataFrame]:
    entity = catalog.get(name)
    relation = entity.relations.get(relation_name)
    if relation is None:
        raise ODataError(f"unknown relation {relation_name!r}", 404)
    if relation.kind == "one" and not relation.through:
        return link(catalog, name, key, relation_name, None)
    if target_key is None:
        raise ODataError("the target's key is needed")
    target = catalog.get(relation.target)
    if relation.through:
        row = catalog.frame(entity.name).filter(at_key(entity.keys, key)).first()
        found = catalog.frame(target.name).filter(at_key(target.keys, target_key)).first()
        if row is None or found is None:
            raise ODataError("no such link", 404)
        rows = catalog.frame(relation.through)
        hit = (quoted(relation.through_source) == F.lit(row[relation.source_key])) & (quoted(relation.through_target) == F.lit(found[relation.target_key]))
        return {catalog.get(relation.through).name: rows.filter(~F.coalesce(hit, F.lit(False)))}
    return {target.name: patch(catalog.frame(target.name), target.keys, target_key, {relation.target_key: None})}


def cascade(catalog: Catalog, name: str, doomed: DataFrame, owned: dict[str, tuple[str, ...]], depth: int = 1, *, changed: dict[str, DataFrame] | None = None, most: int | None = None) -> dict[str, DataFrame]:
    """Tables after deleting ``doomed`` rows of a set with what they own.

    ``owned`` names the containing relations per set. A restricting relation
    with children is a conflict; a cascading one deletes them, level by level, by semi- and
    anti-joins.
    """
    if depth > 8:
        raise ODataError("a composition nests 8 deep at most", 422)
    changed, most = {} if changed is None else changed, catalog.limits.cascade if most is None else most
    entity = catalog.get(name)
    if doomed.limit(most + 1).count() > most:
        raise ODataError(f"a delete takes {most} entities at most", 422)
    for relation_name in owned.get(entity.name, ()):
        relation: Relation = entity.relations[relation_name]
        target = catalog.get(relation.target)
        rows = changed.get(target.name, catalog.frame(target.name))
        owners = doomed.select(quoted(relation.source_key).alias("__owner")).distinct()
        children = rows.join(owners, quoted(relation.target_key) == quoted("__owner"), "left_semi")
        if children.isEmpty():
            continue
        if relation.on_delete == "restrict":
            raise ODataError(f"{entity.name} still has {relation_name}", 409)
        cascade(catalog, target.name, children, owned, depth + 1, changed=changed, most=most)
    frame = changed.get(entity.name, catalog.frame(entity.name))
    changed[entity.name] = delete_many(frame, entity.keys, doomed)
    return changed

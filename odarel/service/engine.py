"""The engine: requests over a catalog, as DataFrames or as paged envelopes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, quote, unquote, urlencode

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from odarel.catalog import Catalog, EntitySet, Limits
from odarel.errors import ODataError
from odarel.functions.scalar import literal
from odarel.operators import query as collection
from odarel.operators import writes
from odarel.operators.delta import bucket_changes, changed, tombstones
from odarel.operators.paging import after
from odarel.operators.scope import EntityScope, linked, quoted
from odarel.plans.ast import Lit, Options, Path
from odarel.plans.lexer import split_top
from odarel.plans.parser import Parser, parse_options
from odarel.service import etag as tags
from odarel.service import tokens
from odarel.service.ahead import Ahead, Stretch, place, stable
from odarel.service.registry import Registry
from odarel.sources import envelope, metadata, snapshots


@dataclass
class Config:
    """Limits and secrets. ``strict`` refuses what ``lenient`` clamps or ignores."""

    secret: str
    base: str = "/odata"
    strict: bool = True
    page_size: int = 200
    max_top: int | None = None
    max_skip: int | None = None
    search_mode: str = "annotated"
    delta: bool = False
    skip_ttl: int = tokens.SKIP_TTL
    delta_ttl: int = tokens.DELTA_TTL
    owned: dict[str, tuple[str, ...]] = field(default_factory=dict)
    limits: Limits = field(default_factory=Limits)


#: An address: set, key, and what follows.
_STEP = re.compile(r"(?P<name>[\w$@.]+)(?:\((?P<key>.*)\))?$", re.DOTALL)


class Engine:
    def __init__(self, catalog: Catalog, config: Config, registry: Registry | None = None):
        self.catalog, self.config, self.registry = catalog, config, registry or Registry()
        self.spark = catalog.spark
        catalog.limits = config.limits
        self.singletons: dict[str, tuple[str, Callable[[], tuple] | tuple]] = {}
        self._ahead = Ahead()

    # DataFrames

    def query(self, name: str, options: str | Mapping[str, str] | Options = "", *, raw_filter: Mapping | None = None) -> DataFrame:
        """A collection query as one plan; nothing runs until the result is used."""
        planned, df = self._planned(name, self._options(options), raw_filter)
        return planned.shown(planned.paged()) if df is None else df

    def _options(self, options) -> Options:
        if isinstance(options, Options):
            return options
        o = parse_options(options, strict=self.config.strict)
        for name, most in (("top", self.config.max_top), ("skip", self.config.max_skip)):
            if most is not None and (getattr(o, name) or 0) > most:
                if self.config.strict:
                    raise ODataError(f"${name} is {most} at most")
                setattr(o, name, most)
        return o

    def _base(self, entity: EntitySet, raw_filter: Mapping | None) -> DataFrame | None:
        """The raw filter object: where (nested and, or, operators), fields."""
        if not raw_filter:
            return None
        scope = EntityScope(self.catalog, entity, self.catalog.frame(entity.name))
        if where := raw_filter.get("where"):
            scope.df_filter(raw_where(scope, where))
        return scope.df

    def _planned(self, name: str, o: Options, raw_filter: Mapping | None = None) -> tuple[collection.Planned, DataFrame | None]:
        """The plan, and the whole result where an executor gave it."""
        return self._plan(name, o, raw_filter, self._prepared(name, o, raw_filter))

    def _prepared(self, name: str, o: Options, raw_filter: Mapping | None = None) -> dict:
        """Complete the options by the raw filter and the hooks."""
        entity = self.catalog.get(name)
        if raw_filter:
            o.top = raw_filter.get("limit", o.top) if o.top is None else o.top
            o.skip = raw_filter.get("offset", raw_filter.get("skip", o.skip)) if o.skip is None else o.skip
            if o.select is None and isinstance(raw_filter.get("fields"), list):
                o.select = list(raw_filter["fields"])
            if not o.orderby and raw_filter.get("order"):
                order = raw_filter["order"]
                from_text = parse_options({"$orderby": ",".join([order] if isinstance(order, str) else order)})
                o.orderby = from_text.orderby
            for relation in raw_filter.get("include", ()):
                o.expand += parse_options({"$expand": relation["relation"] if isinstance(relation, dict) else relation}).expand
        context = {"set": entity.name, "options": o, "engine": self}
        self.registry.run("before", "READ", entity.name, context)
        return context

    def _plan(self, name: str, o: Options, raw_filter: Mapping | None, context: dict) -> tuple[collection.Planned, DataFrame | None]:
        entity = self.catalog.get(name)
        if o.apply is not None:
            for supports, execute in self.registry.executors:
                if supports(context) and (df := execute(context)) is not None:
                    from odarel.operators.apply import Pipeline
                    from odarel.operators.scope import FlatScope

                    done = Pipeline(FlatScope(df), list(df.columns))
                    return collection.Planned(done.scope, done.default_order(), o, done), df
        return collection.plan(self.catalog, name, o, search_mode=self.config.search_mode, base=self._base(entity, raw_filter)), None

    def entity(self, name: str, key=None) -> DataFrame:
        """One entity, or a singleton by its name, as a DataFrame of at most a row."""
        if name in self.singletons:
            name, key = self.singletons[name]
            key = key() if callable(key) else key
        entity = self.catalog.get(name)
        return self.catalog.frame(entity.name).filter(writes.at_key(entity.keys, key if isinstance(key, tuple) else (key,)))

    def navigation(self, name: str, key, relation: str, options: str | Mapping[str, str] | Options = "") -> DataFrame:
        """What an entity's relation leads to, with a query's options."""
        planned = self._related(self.catalog.get(name), key if isinstance(key, tuple) else (key,), relation, self._options(options))
        return planned.shown(planned.paged())

    def _related(self, entity: EntitySet, key: tuple, name: str, o: Options) -> collection.Planned:
        if o.apply is not None:
            raise ODataError("$apply on a navigation property", 501)
        if (relation := entity.relations.get(name)) is None:
            raise ODataError(f"unknown relation {name!r} of {entity.name}", 404)
        owner = self.catalog.frame(entity.name).filter(writes.at_key(entity.keys, key)).select(quoted(relation.source_key).alias("__owner"))
        rows = linked(self.catalog, relation, "", "__link")
        rows = rows.join(owner, quoted("__link") == quoted("__owner"), "left_semi").drop("__link")
        return collection.plan(self.catalog, relation.target, o, base=rows, search_mode=self.config.search_mode)

    def count(self, name: str, options: str | Mapping[str, str] = "") -> int:
        """Rows that match, before paging."""
        o = self._options(options)
        if o.format is not None or o.compute:
            raise ODataError("$count takes neither $format nor $compute")
        o.top = o.skip = None
        o.orderby, o.expand, o.select = [], [], None
        return collection.plan(self.catalog, name, o, search_mode=self.config.search_mode).scope.df.count()

    def call(self, name: str, entity_set: str | None = None, key: tuple | None = None, **params):
        """Run a function or action on nothing, a collection or an entity."""
        op = self.registry.find(name, entity_set)
        df = self.catalog.frame(entity_set) if entity_set else None
        if op.binding == "entity":
            if key is None:
                raise ODataError(f"{name} needs a key")
            df = df.filter(writes.at_key(self.catalog.get(entity_set).keys, key))
        return op.run(self.spark, df, **op.typed(params))

    def singleton(self, name: str, entity_set: str, key) -> None:
        """A named entity; ``key`` is its key or gives it."""
        self.singletons[name] = (entity_set, key)

    # addresses

    def get(self, url: str, *, if_none_match: str | None = None, prefer: str = "") -> dict | str | int | bytes | None:
        """Answer a GET. Envelopes for collections and entities; plain values for $value and $count; None for no content."""
        path, _, text = url.partition("?")
        path = path.removeprefix(self.config.base).strip("/")
        options = dict(parse_qsl(text.replace("+", "%2B"), keep_blank_values=True))
        raw_filter = json.loads(options["filter"]) if "filter" in options else None
        parts = [unquote(p) for p in split_top(path, "/")] if path else []
        if not parts:
            return metadata.service_document(self.catalog, self.config.base, self.singletons)
        if parts[0] == "$metadata":
            extra = {"singletons": self.singletons, "operations": list(self.registry.operations.values())}
            return metadata.metadata(self.catalog, **extra) if "json" in options.get("$format", "") else metadata.metadata_xml(self.catalog, **extra)
        m = _STEP.match(parts[0])
        if not m:
            raise ODataError(f"invalid address {path!r}", 404)
        name, key_text = m["name"], m["key"]
        if name in self.singletons:
            entity_set, key = self.singletons[name]
            key = key() if callable(key) else key
            return self._entity(self.catalog.get(entity_set), key if isinstance(key, tuple) else (key,), parts[1:], options, if_none_match)
        if (None, name) in self.registry.operations:
            return self._called(self.call(name, **self._arguments(key_text)))
        entity = self.catalog.get(name)
        if key_text is not None:
            return self._entity(entity, self._key(entity, key_text), parts[1:], options, if_none_match)
        if len(parts) == 2 and parts[1] == "$count":
            return self.count(entity.name, options)
        if len(parts) == 2 and (op := _STEP.match(parts[1])) and (entity.name.lower(), op["name"].split(".")[-1]) in self.registry.operations:
            return self._called(self.call(op["name"].split(".")[-1], entity.name, **self._arguments(op["key"])))
        if len(parts) > 1:
            raise ODataError(f"invalid address {path!r}", 404)
        return self._collection(entity, path, options, raw_filter, prefer)

    def _arguments(self, text: str | None) -> dict:
        pairs = (x.split("=", 1) for x in split_top(text, ",")) if text else ()
        return {k.strip(): Parser(v.strip()).whole().value for k, v in pairs}

    def _called(self, result):
        return {"value": envelope.rows(result)} if isinstance(result, DataFrame) else {"value": result}

    def _key(self, entity: EntitySet, text: str) -> tuple:
        parts = [x.strip() for x in split_top(text, ",")]
        kinds = {f.name: f.dataType for f in self.catalog.frame(entity.name).schema.fields}
        named = dict(x.split("=", 1) for x in parts) if all(re.match(r"\w+=", x) for x in parts) else dict(zip(entity.keys, parts, strict=False))
        if set(named) != set(entity.keys):
            raise ODataError(f"the key of {entity.name} is {', '.join(entity.keys)}")
        out = []
        for k in entity.keys:
            lit = Parser(named[k]).whole()
            if not isinstance(lit, Lit):
                raise ODataError(f"{named[k]!r} isn't a literal")
            literal(lit, kinds[k])  # refuses what doesn't fit
            out.append(lit.value)
        return tuple(out)

    # collections

    def _context(self, path: str, options: Mapping[str, str]) -> str:
        kept = sorted((k, v) for k, v in options.items() if k not in ("$skiptoken", "$skip"))
        return f"GET:{path}?{urlencode(kept, quote_via=quote)}"

    def _collection(self, entity: EntitySet, path: str, options: dict[str, str], raw_filter: Mapping | None, prefer: str = "") -> dict:
        o = self._options(options)
        if (taken := self.registry.run("on", "READ", entity.name, {"set": entity.name, "options": o, "engine": self})) is not None:
            return taken if isinstance(taken, dict) else self._called(taken)
        if o.deltatoken is not None:
            return self._delta(entity, o, path)
        preferred = re.search(r"odata\.maxpagesize=(\d+)|(?:^|[,\s])maxpagesize=(\d+)", prefer)
        page = min(self.config.page_size, int(preferred[1] or preferred[2]) or 1) if preferred else self.config.page_size
        top, skip = o.top, o.skip
        context = self._context(path, options)
        o.top = o.skip = None
        prepared = self._prepared(entity.name, o, raw_filter)
        top, skip = (o.top if top is None else top), (o.skip if skip is None else skip)
        o.top = o.skip = None
        taken_before, link, values = 0, None, None
        if o.skiptoken is not None:
            payload = tokens.verify(o.skiptoken, self.config.secret, self.config.skip_ttl)
            if payload.get("context") != context:
                raise ODataError("the token belongs to another query")
            taken_before, link, values = payload["taken"], payload.get("delta"), payload["values"]
        room = page if top is None else min(page, max(0, top - taken_before))
        state = self._state(o, raw_filter)
        found = None if values is None else self._ahead.find(context, state, values, room)
        if found is None:
            planned, _ = self._plan(entity.name, o, raw_filter, prepared)
            total = planned.scope.df.count() if o.count else None  # before anything is skipped
            if self.config.delta and values is None:  # of the state before the first page, so that nothing changed meanwhile is missed
                link = self._delta_link(entity, planned, path, options)
            left = None if top is None else max(0, top - taken_before)
            found = self._read(planned, context if values is not None else None, state, values, room, skip=None if values is not None else skip, left=left), 0
            found[0].total = total
        stretch, at = found
        planned, total = stretch.planned, stretch.total
        got, value = self._page(stretch, at, room)
        more = len(stretch.rows) > at + room and (top is None or top - taken_before > room)
        self._decorate(entity, planned, value)
        out: dict = {"@odata.context": f"{self.config.base}/$metadata#{entity.name}"}
        if total is not None:
            out["@odata.count"] = total
        out["value"] = value
        if more and got:
            values = [envelope.plain(got[-1][f"__mark{i}"]) for i in range(len(planned.orders))]
            stretch.places[place(values)] = at + len(got)
            token = tokens.sign({"context": context, "values": values, "taken": taken_before + len(got)} | ({} if link is None else {"delta": link}), self.config.secret)
            rest = {k: v for k, v in options.items() if k not in ("$skip", "$skiptoken")}
            out["@odata.nextLink"] = f"{self.config.base}/{path}?{urlencode(rest | {'$skiptoken': token}, quote_via=quote)}"
        elif link is not None and not more:
            out["@odata.deltaLink"] = link
        self.registry.run("after", "READ", entity.name, {"set": entity.name, "result": out, "engine": self})
        return out

    def _state(self, o: Options, raw_filter: Mapping | None = None) -> tuple:
        """What a page's rows depend on besides its place."""
        return (replace(o, skiptoken=None, deltatoken=None), raw_filter), self.catalog.state(), self.config.search_mode

    def _read(self, planned: collection.Planned, key: str | None, state: tuple, values: list | None, room: int, *, skip: int | None = None, left: int | None = None) -> Stretch:
        """A page's rows in order, and the next; for ``key``, further rows that are kept for the pages after it.

        Only ``left`` rows are wanted in all. To be expanded, rows stay as they are until their page is asked for.
        """
        o, scope = planned.options, planned.scope
        custom = o.apply is not None and bool(self.registry.executors)  # they decide anew for each request
        size = room + 1
        if key is not None and not custom and stable(scope.df):
            ahead = self._ahead.size(key, state, room)
            size = max(size, ahead if left is None else min(ahead, left + 1))
        else:
            key = None
        if values is not None:
            scope.df = scope.df.filter(after(scope, planned.orders, values))
        by = planned.sorted()
        marks = [scope.compiler.column(x.expr).alias(f"__mark{i}") for i, x in enumerate(planned.orders)]
        df = scope.df.orderBy(*by) if by else scope.df
        if skip:
            df = df.offset(skip)
        df = df.limit(size)
        whole = df.select("*", *marks) if marks else df
        if planned.pipeline is not None or not o.expand:
            whole = self._shown_marked(planned, whole, len(marks))
        rows = whole.collect()
        stretch = Stretch(planned, whole, rows, ended=len(rows) < size)
        if key is not None:
            stretch.places[place(values)] = 0
            self._ahead.keep(key, state, stretch, size)
        return stretch

    def _page(self, stretch: Stretch, at: int, room: int) -> tuple[list[Row], list[dict]]:
        """A page's rows with the order's values, and as the client sees them; a page is expanded by itself."""
        got, shown, planned = stretch.rows[at : at + room], stretch.shown, stretch.planned
        if planned.pipeline is None and planned.options.expand:
            found = self.spark.createDataFrame([tuple(r) for r in got], shown.schema)
            shown = self._shown_marked(planned, found, len(planned.orders))
            got = shown.collect()
        fields = [(i, f.name, f.dataType) for i, f in enumerate(shown.schema.fields) if not f.name.startswith("__mark")]
        return got, [{name: envelope.plain(r[i], kind) for i, name, kind in fields} for r in got]

    def _shown_marked(self, planned: collection.Planned, df: DataFrame, marks: int) -> DataFrame:
        """What the client sees, with the order's values beside it."""
        if planned.pipeline is not None:
            return df.drop("__branch")
        scope, o = planned.scope, planned.options
        names = [c for c in dict.fromkeys([*collection.chosen(scope.entity, scope.names(), o)])]
        extra = [f"__mark{i}" for i in range(marks)]
        if scope.entity.etag:
            df = df.withColumn("__marketag", quoted(scope.entity.etag))
            extra.append("__marketag")
        if o.expand:
            keep = [*dict.fromkeys([*scope.names(), *[a for _, a in o.compute]])]
            df = collection.expand(self.catalog, scope.entity, df.select(*[quoted(c) for c in keep], *extra), o.expand, few=True, search_mode=self.config.search_mode)
            names += [x for x in dict.fromkeys(e.path[0] for e in o.expand)]
            order = [F.col(f"__mark{i}").desc_nulls_first() if x.desc else F.col(f"__mark{i}").asc_nulls_last() for i, x in enumerate(planned.orders)]
            df = df.orderBy(*order)
        return df.select(*[quoted(c) for c in names], *extra)

    def _decorate(self, entity: EntitySet, planned: collection.Planned, value: list[dict]) -> None:
        if planned.pipeline is None and entity.etag:
            for row in value:
                if entity.etag in row:
                    row["@odata.etag"] = tags.etag(row[entity.etag])

    # change feeds

    def _delta_link(self, entity: EntitySet, planned: collection.Planned, path: str, options: dict[str, str]) -> str | None:
        """A link with the greatest delta value and the keys or groups there are, to tell what goes.

        Up to a page of them are in the token; more are written, and the token names them.
        """
        o = planned.options
        payload: dict = {"entitySet": entity.name, "options": {k: v for k, v in options.items() if k not in ("$skiptoken", "$top", "$skip", "$count")}}
        most = self.config.page_size
        if planned.pipeline is not None:
            rows = envelope.rows(planned.scope.df.limit(most + 1))
            if len(rows) > most:
                payload["groups"] = snapshots.save(planned.scope.df)
            else:
                payload["buckets"] = rows
        else:
            if entity.delta is None:
                return None
            parts = [entity.delta, *entity.keys]
            mark = planned.scope.df.agg(F.max(F.struct(*[quoted(p) for p in parts])).alias("m")).first()["m"]
            if mark is not None:
                payload["lastValue"], payload["keyValues"] = envelope.plain(mark[0]), [envelope.plain(v) for v in mark[1:]]
            all_keys = planned.scope.df.select(*[quoted(k) for k in entity.keys])
            keys = all_keys.limit(most + 1).collect()
            if len(keys) > most:
                payload["keys"] = snapshots.save(all_keys)
            else:
                payload["pageKeys"] = [[envelope.plain(v) for v in r] for r in keys]
        token = tokens.sign(payload, self.config.secret)
        return f"{self.config.base}/{path}?{urlencode({'$deltatoken': token}, quote_via=quote)}"

    def _delta(self, entity: EntitySet, o: Options, path: str) -> dict:
        """A page of changes; the last one also has what is gone, and the link taken before the first."""
        if not self.config.delta:
            raise ODataError("delta is not enabled")
        payload = tokens.verify(o.deltatoken, self.config.secret, self.config.delta_ttl, expired=410)
        if payload.get("entitySet") != entity.name:
            raise ODataError("the token belongs to another set")
        again = self._options(payload["options"])
        prepared = self._prepared(entity.name, again)
        out: dict = {"@odata.context": f"{self.config.base}/$metadata#{entity.name}/$delta"}
        state, page = self._state(again), self.config.page_size
        context = f"DELTA:{path}?{json.dumps({k: v for k, v in payload.items() if k not in ('after', 'issuedAt')}, sort_keys=True)}"
        found = self._ahead.find(context, state, payload["after"], page) if "after" in payload else None
        if found is not None and len(found[0].rows) > found[1] + page:  # the last page needs the plan, too
            return out | self._changes(found, page, path, payload, payload["link"])
        planned, _ = self._plan(entity.name, again, None, prepared)
        link = payload["link"] if "after" in payload else self._delta_link(entity, planned, path, payload["options"])
        if "buckets" in payload or "groups" in payload:
            now = planned.scope.df
            schema = now.schema
            before = snapshots.load(self.spark, payload["groups"], now) if "groups" in payload else self.spark.createDataFrame([], schema)
            if payload.get("buckets"):
                texts = self.spark.createDataFrame([(json.dumps(b),) for b in payload["buckets"]], "j string")
                before = texts.select(F.from_json("j", schema).alias("b")).select("b.*")
            group = [s for s in again.apply if hasattr(s, "keys")][-1]
            changes = bucket_changes(before, now, [k.name for k in group.keys]) if group.keys else now.withColumn("@removed", F.lit(None).cast("string"))
            value = [{k: v for k, v in r.items() if k != "@removed" or v} for r in envelope.rows(changes)]
        else:
            before, now = None, planned.scope.df  # all there is, whatever has changed
            if "keys" in payload:
                before = snapshots.load(self.spark, payload["keys"], now.select(*[quoted(k) for k in entity.keys]))
            elif "pageKeys" in payload:
                kinds = {f.name: f.dataType for f in planned.scope.df.schema.fields}
                schema = ", ".join(f"`{k}` string" for k in entity.keys)
                rows = [tuple(None if v is None else str(v) for v in r) for r in payload["pageKeys"]]
                before = self.spark.createDataFrame(rows, schema).select(*[quoted(k).cast(kinds[k]).alias(k) for k in entity.keys])
            if "lastValue" in payload:
                planned.scope.df = planned.scope.df.filter(changed(planned.scope, payload["lastValue"], payload["keyValues"]))
            if found is None:
                found = self._read(planned, context if "after" in payload else None, state, payload.get("after"), page), 0
            some = self._changes(found, page, path, payload, link)
            if "@odata.nextLink" in some:
                return out | some
            value = some["value"]
            if before is not None:
                value += [{"@removed": {"reason": "deleted"}, **{k: r[k] for k in entity.keys}} for r in envelope.rows(tombstones(before, now, list(entity.keys)))]
        if link is not None:
            out["@odata.deltaLink"] = link
        return out | {"value": value}

    def _changes(self, found: tuple[Stretch, int], page: int, path: str, payload: dict, link: str | None) -> dict:
        """A page of changed rows, with the link to the next if there are more."""
        stretch, at = found
        got, value = self._page(stretch, at, page)
        if len(stretch.rows) <= at + page:
            return {"value": value}
        values = [envelope.plain(got[-1][f"__mark{i}"]) for i in range(len(stretch.planned.orders))]
        stretch.places[place(values)] = at + len(got)
        token = tokens.sign(payload | {"after": values, "link": link}, self.config.secret)
        return {"@odata.nextLink": f"{self.config.base}/{path}?{urlencode({'$deltatoken': token}, quote_via=quote)}", "value": value}

    # entities

    def _entity(self, entity: EntitySet, key: tuple, rest: list[str], options: dict[str, str], if_none_match: str | None):
        o = self._options(options)
        base = self.catalog.frame(entity.name).filter(writes.at_key(entity.keys, key))
        if rest and rest[0] in entity.relations:
            return self._navigation(entity, key, rest, options)
        if rest and (op := _STEP.match(rest[0])) and (entity.name.lower(), op["name"].split(".")[-1]) in self.registry.operations:
            return self._called(self.call(op["name"].split(".")[-1], entity.name, key, **self._arguments(op["key"])))
        if rest:
            return self._property(entity, base, rest)
        planned = collection.plan(self.catalog, entity.name, o, base=base)
        found = planned.shown(planned.scope.df.limit(1))
        value = envelope.rows(found)
        if not value:
            raise ODataError(f"{entity.name} has no such entity", 404)
        out = {"@odata.context": f"{self.config.base}/$metadata#{entity.name}/$entity", **value[0]}
        if entity.etag:
            mark = tags.etag(envelope.plain(base.select(quoted(entity.etag)).first()[0]))
            if if_none_match is not None and mark in if_none_match:
                return None
            out["@odata.etag"] = mark
        return out

    def _property(self, entity: EntitySet, base: DataFrame, rest: list[str]):
        raw = rest[-1] == "$value"
        path = rest[:-1] if raw else rest
        scope = EntityScope(self.catalog, entity, base)
        column, _ = scope.resolve(Path(tuple(path)))
        row = scope.df.select(column.alias("v")).first()
        if row is None:
            raise ODataError(f"{entity.name} has no such entity", 404)
        if row[0] is None:
            return None
        if raw:
            return envelope.raw(row[0])
        return {"@odata.context": f"{self.config.base}/$metadata#{entity.name}/{'/'.join(path)}", "value": envelope.rows(scope.df.select(column.alias("v")))[0]["v"]}

    def _navigation(self, entity: EntitySet, key: tuple, rest: list[str], options: dict[str, str]):
        relation, target = entity.relations[rest[0]], self.catalog.get(entity.relations[rest[0]].target)
        o = self._options(options)
        planned = self._related(entity, key, rest[0], o)
        if self.entity(entity.name, key).isEmpty():
            raise ODataError(f"{entity.name} has no such entity", 404)
        if len(rest) == 2 and rest[1] == "$count":
            return planned.scope.df.count()
        one = relation.kind == "one" and not relation.through
        found = planned.shown(planned.paged(always=not one))
        value = envelope.rows(found.limit(1) if one else found)
        if one:
            return {"@odata.context": f"{self.config.base}/$metadata#{target.name}/$entity", **value[0]} if value else None
        out = {"@odata.context": f"{self.config.base}/$metadata#{target.name}"}
        if o.count:
            out["@odata.count"] = len(value)
        return out | {"value": value}

    # writes

    def _store(self, changed_tables: dict[str, DataFrame]) -> None:
        for name, frame in changed_tables.items():
            self.catalog.replace(name, frame)

    def create(self, name: str, body: dict) -> dict:
        entity = self.catalog.get(name)
        context = {"set": entity.name, "body": body, "engine": self}
        self.registry.run("before", "CREATE", entity.name, context)
        if (taken := self.registry.run("on", "CREATE", entity.name, context)) is None:
            self._store(writes.deep_insert(self.catalog, entity.name, body))
            own = {k: v for k, v in body.items() if k not in entity.relations}
            taken = {"@odata.context": f"{self.config.base}/$metadata#{entity.name}/$entity", **own, "Location": f"{self.config.base}/{entity.name}({','.join(repr(own.get(k)) for k in entity.keys)})"}
        self.registry.run("after", "CREATE", entity.name, context | {"result": taken})
        return taken

    def _current(self, entity: EntitySet, key: tuple, if_match: str | None) -> None:
        row = self.catalog.frame(entity.name).filter(writes.at_key(entity.keys, key)).first()
        if row is None:
            raise ODataError(f"{entity.name} has no such entity", 404)
        if entity.etag:
            tags.check(tags.etag(envelope.plain(row[entity.etag])), if_match)

    def update(self, name: str, key, body: dict, *, if_match: str | None = None, replace: bool = False) -> None:
        entity, key = self.catalog.get(name), key if isinstance(key, tuple) else (key,)
        context = {"set": entity.name, "key": key, "body": body, "engine": self}
        self.registry.run("before", "UPDATE", entity.name, context)
        if self.registry.run("on", "UPDATE", entity.name, context) is None:
            self._current(entity, key, if_match)
            if replace:
                self.catalog.replace(entity.name, writes.replace(self.catalog.frame(entity.name), entity.keys, key, body))
            else:
                self._store(writes.deep_update(self.catalog, entity.name, key, body))
        self.registry.run("after", "UPDATE", entity.name, context)

    def delete(self, name: str, key, *, if_match: str | None = None) -> None:
        entity, key = self.catalog.get(name), key if isinstance(key, tuple) else (key,)
        context = {"set": entity.name, "key": key, "engine": self}
        self.registry.run("before", "DELETE", entity.name, context)
        if self.registry.run("on", "DELETE", entity.name, context) is None:
            self._current(entity, key, if_match)
            doomed = self.catalog.frame(entity.name).filter(writes.at_key(entity.keys, key))
            self._store(writes.cascade(self.catalog, entity.name, doomed, self.config.owned))
        self.registry.run("after", "DELETE", entity.name, context)

    def link(self, name: str, key, relation: str, target) -> None:
        self._reference("LINK", writes.link, name, key, relation, target)

    def unlink(self, name: str, key, relation: str, target=None) -> None:
        self._reference("UNLINK", writes.unlink, name, key, relation, target)

    def _reference(self, event: str, change: Callable, name: str, key, relation: str, target) -> None:
        entity, key = self.catalog.get(name), key if isinstance(key, tuple) else (key,)
        target = target if target is None or isinstance(target, tuple) else (target,)
        context = {"set": entity.name, "key": key, "relation": relation, "target": target, "engine": self}
        self.registry.run("before", event, entity.name, context)
        if self.registry.run("on", event, entity.name, context) is None:
            self._store(change(self.catalog, entity.name, key, relation, target))
        self.registry.run("after", event, entity.name, context)


def raw_where(scope: EntityScope, where: Mapping):
    """A filter object: ``{field: value or {operator: value}}``, with ``and`` and ``or`` lists."""
    terms = []
    for name, value in where.items():
        if name in ("and", "or"):
            parts = [raw_where(scope, x) for x in value]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if name == "and" else out | p
            terms.append(out)
            continue
        column, _ = scope.resolve(Path(tuple(name.split("."))))
        for op, v in (value.items() if isinstance(value, Mapping) else [("eq", value)]):
            terms.append(_raw_term(column, op, v))
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def _raw_term(column, op: str, v):
    if op in ("eq", "neq") and v is None:
        return column.isNull() if op == "eq" else column.isNotNull()
    table = {
        "eq": lambda: column == v, "neq": lambda: column != v, "gt": lambda: column > v, "gte": lambda: column >= v, "lt": lambda: column < v, "lte": lambda: column <= v,
        "inq": lambda: column.isin(list(v)), "nin": lambda: ~column.isin(list(v)), "between": lambda: column.between(v[0], v[1]), "like": lambda: column.like(v),
        "nlike": lambda: ~column.like(v), "ilike": lambda: column.ilike(v), "nilike": lambda: ~column.ilike(v), "exists": lambda: column.isNotNull() if v else column.isNull(),
    }
    if op not in table:
        raise ODataError(f"unknown operator {op!r}")
    return table[op]()

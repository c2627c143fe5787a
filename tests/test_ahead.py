"""Following links: many pages from one plan, and what changes meanwhile is seen."""

import pytest
from pyspark.sql import functions as F

from odarel.catalog import Catalog, EntitySet, Relation
from odarel.service import ahead
from odarel.service.engine import Config, Engine
from odarel.service.registry import Registry
from odarel.sources.tables import memory

N = 100


def sets():
    things = memory([(i, i % 7, 1, None if i % 10 == 0 else i / 4) for i in range(N)], "id long, kind int, changed int, x double")
    parts = memory([(i, i % 50) for i in range(150)], "id long, thing long")
    return [
        EntitySet("Things", ("id",), things, delta="changed").relate(Relation("parts", "Parts", "id", "thing", "many")),
        EntitySet("Parts", ("id",), parts),
    ]


def engine_of(spark, registry=None, **options):
    return Engine(Catalog(spark, sets()), Config(**{"secret": "s", "page_size": 3} | options), registry)


@pytest.fixture
def collects(monkeypatch, spark):
    """How often a plan's rows were fetched."""
    kind, seen = type(spark.range(1)), []
    plain = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(1) or plain(self))
    return seen


def followed(engine, url, then=lambda page: None):
    value, sizes = [], []
    while url:
        page = engine.get(url)
        value += page["value"]
        sizes.append(len(page["value"]))
        then(page)
        url = page.get("@odata.nextLink")
    return value, sizes


ORDERS = {"x desc,kind": lambda i: (i % 10 != 0, -i / 4 if i % 10 else 0, i % 7, i), "kind desc": lambda i: (-(i % 7), i), "x": lambda i: (i % 10 == 0, i / 4 if i % 10 else 0, i)}


@pytest.mark.parametrize("order", ORDERS)
def test_all_pages_from_few_plans(spark, collects, order):
    counts = []
    got, sizes = followed(engine_of(spark), f"Things?$orderby={order}&$select=id&$count=true", lambda p: counts.append(p["@odata.count"]))
    assert [r["id"] for r in got] == sorted(range(N), key=ORDERS[order])
    assert sizes == [3] * 33 + [1] and set(counts) == {N} and len(counts) == 34
    assert len(collects) < 12  # one for each page before


def test_changes_from_few_plans(spark, collects):
    engine = engine_of(spark, delta=True)
    links = []
    followed(engine, "Things", lambda p: links.append(p.get("@odata.deltaLink")))
    later = engine.catalog.frame("Things").filter("id % 5 <> 0").withColumn("changed", F.when(F.col("id") % 2 == 0, 2).otherwise(1))
    engine.catalog.replace("Things", later)
    del collects[:]
    got, sizes = followed(engine, links[-1], lambda p: links.append(p.get("@odata.deltaLink")))
    assert [r["id"] for r in got if "@removed" not in r] == [i for i in range(N) if i % 5 and i % 2 == 0]
    assert sorted(r["id"] for r in got if "@removed" in r) == list(range(0, N, 5))
    assert len(sizes) == 14 and sizes[:-1] == [3] * 13 and len(collects) < 13  # two for each page before
    assert len([x for x in links if x]) == 2 and engine.get(links[-1])["value"] == []


def test_top_expand_and_groups(spark):
    engine = engine_of(spark)
    assert followed(engine, "Things?$top=20&$skip=5&$select=id") == ([{"id": i} for i in range(5, 25)], [3] * 6 + [2])
    got, _ = followed(engine, "Things?$top=12&$orderby=id desc&$select=id&$expand=parts($select=id)")
    assert [(r["id"], sorted(p["id"] for p in r["parts"])) for r in got] == [(i, []) for i in range(99, 87, -1)]
    got, _ = followed(engine, "Things?$top=8&$select=id&$expand=parts($select=id)")
    assert [(r["id"], sorted(p["id"] for p in r["parts"])) for r in got] == [(i, [i, i + 50, i + 100]) for i in range(8)]
    got, _ = followed(engine, "Things?$apply=groupby((kind),aggregate($count as n))")
    assert [(r["kind"], r["n"]) for r in got] == [(k, len(range(k, N, 7))) for k in range(7)]


def test_what_changes_between_pages_is_seen(spark):
    engine = engine_of(spark)
    links = ["Things?$select=id&$count=true"]
    for _ in range(4):
        links.append(engine.get(links[-1])["@odata.nextLink"])
    assert [r["id"] for r in engine.get(links[3])["value"]] == [9, 10, 11]  # again, by the same link
    engine.delete("Things", 13)
    page = engine.get(links[4])
    assert [r["id"] for r in page["value"]] == [12, 14, 15] and page["@odata.count"] == N - 1
    engine.catalog.replace("Things", engine.catalog.frame("Things").filter("id <> 16"))
    page = engine.get(page["@odata.nextLink"])
    assert [r["id"] for r in page["value"]] == [17, 18, 19] and page["@odata.count"] == N - 2
    engine.config.page_size = 5
    assert [r["id"] for r in engine.get(page["@odata.nextLink"])["value"]] == [20, 21, 22, 23, 24]


def test_hooks_decide_for_each_page(spark):
    registry, most = Registry(), [99]
    from odarel.plans.parser import parse_options

    @registry.hook("before", "READ", "Things")
    def allowed(context):
        context["options"].filter = parse_options({"$filter": f"id le {most[0]}"}).filter

    engine = engine_of(spark, registry)
    page = engine.get("Things?$select=id")
    page = engine.get(page["@odata.nextLink"])
    most[0] = 7
    page = engine.get(page["@odata.nextLink"])
    assert [r["id"] for r in page["value"]] == [6, 7] and "@odata.nextLink" not in page


def test_bounds(spark, monkeypatch):
    engine = engine_of(spark)
    assert ahead.stable(engine.catalog.frame("Things")) and not ahead.stable(engine.catalog.frame("Things").withColumn("r", F.rand()))
    monkeypatch.setattr(ahead, "ROWS", 10)
    monkeypatch.setattr(ahead, "READERS", 2)
    for kind in range(4):
        got, _ = followed(engine, f"Things?$filter=kind ge {kind}&$select=id")
        assert [r["id"] for r in got] == [i for i in range(N) if i % 7 >= kind]
    kept = engine._ahead._kept
    assert len(kept) == 2 and all(len(s.rows) <= 10 for s in kept.values())
    monkeypatch.setattr(ahead, "SECONDS", -1)  # always too old
    got, _ = followed(engine, "Things?$filter=kind ge 5&$select=id")
    assert [r["id"] for r in got] == [i for i in range(N) if i % 7 >= 5]

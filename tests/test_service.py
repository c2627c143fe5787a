import pytest

from odarel.errors import ODataError
from odarel.service import tokens
from odarel.service.batch import run_batch
from odarel.service.engine import Config, Engine
from odarel.service.registry import Registry
from odarel.sources.envelope import duration, plain
from tests.shop import catalog


@pytest.fixture
def engine(spark):
    return Engine(catalog(spark), Config(secret="s", page_size=3, delta=True, owned={"Orders": ("items",)}))


def pages(engine, url):
    out = []
    while url:
        page = engine.get(url)
        out.append([r.get("id") for r in page["value"]])
        url = page.get("@odata.nextLink")
    return out


def test_paging(engine):
    assert pages(engine, "/odata/Products") == [[1, 2, 3], [4, 5, 6]]
    assert pages(engine, "Products?$orderby=price desc&$filter=price gt 11") == [[3, 5, 1], [4]]
    assert pages(engine, "Products?$top=5&$orderby=name") == [[1, 5, 2], [6, 3]]
    assert pages(engine, "Products?$top=0") == [[]]
    assert pages(engine, "Nulls?$orderby=x") == [[3, 2, 1]]
    assert pages(engine, "Products?$expand=orderItems&$top=4&$skip=1") == [[2, 3, 4], [5]]
    engine.config.page_size = 1
    assert pages(engine, "Nulls?$orderby=x") == [[3], [2], [1]]
    assert pages(engine, "Nulls?$orderby=x desc") == [[1], [2], [3]]
    assert [p for p in pages(engine, "Nulls?$orderby=at desc")] == [[2], [1], [3]]


def test_count_and_format(engine):
    assert engine.get("Products?$count=true&$top=1")["@odata.count"] == 6
    assert engine.get("Products/$count?$filter=price gt 50") == 2
    assert engine.get("Orders(1)/items/$count") == 2
    with pytest.raises(ODataError):
        engine.get("Products/$count?$format=json")


def test_apply_pages(engine):
    page = engine.get("OrderItems?$apply=groupby((productId),aggregate(quantity with sum as q))")
    assert [r["productId"] for r in page["value"]] == [1, 2, 3]
    assert [r["productId"] for r in engine.get(page["@odata.nextLink"])["value"]] == [4, 5]


def test_tokens(engine):
    link = engine.get("Products")["@odata.nextLink"]
    with pytest.raises(ODataError):
        engine.get(link.replace("Products?", "Products?%24filter=id%20gt%201&"))
    with pytest.raises(ODataError):
        engine.get(link[:-3] + "AAA")
    old = tokens.sign({"a": 1}, "s", now=0)
    with pytest.raises(ODataError) as e:
        tokens.verify(old, "s", 10, expired=410)
    assert e.value.status == 410
    assert tokens.verify(tokens.sign({"a": 1}, "s"), "s", 10)["a"] == 1


def test_entities(engine):
    assert engine.get("Products(1)")["name"] == "Garden Spade"
    assert engine.get("Products(id=1)?$select=id&$expand=orderItems")["orderItems"][0]["quantity"] == 2.0
    assert engine.get("Products(1)/name")["value"] == "Garden Spade"
    assert engine.get("Products(1)/name/$value") == "Garden Spade"
    assert engine.get("Products(1)/dimensions/width")["value"] == 18.0
    assert engine.get("MediaAssets(1)/data/$value") == b"\x00\x01"
    assert engine.get("MediaAssets(1)")["big"] == "9223372036854775807"
    assert engine.get("OrderItems(1)/product")["name"] == "Tent Large"
    assert [r["id"] for r in engine.get("Orders(2)/items?$orderby=quantity desc")["value"]] == [4, 3]
    assert [r["id"] for r in engine.get("Orders(2)/products?$filter=price gt 50")["value"]] == [5]
    for url, status in (("Products(99)", 404), ("Nope", 404), ("Products(1)/nope", 400), ("Orders(1)/items?$apply=aggregate($count as n)", 501), ("Products('x')", 400)):
        with pytest.raises(ODataError) as e:
            engine.get(url)
        assert e.value.status == status
    mark = engine.get("Products(1)")["@odata.etag"]
    assert engine.get("Products(1)", if_none_match=mark) is None


def test_singletons_and_metadata(engine):
    engine.singleton("Best", "Products", lambda: 1)
    assert engine.get("Best")["name"] == "Garden Spade" and engine.get("Best/name/$value") == "Garden Spade"
    assert {"Best", "Products"} <= {v["name"] for v in engine.get("")["value"]}
    doc = engine.get("$metadata?$format=json")["Default"]
    assert doc["ProductsType"]["price"]["$Type"] == "Edm.Double" and doc["ProductsType"]["orders"]["$Collection"]
    assert '<Singleton Name="Best"' in engine.get("$metadata")


def test_writes(engine):
    engine.create("Orders", {"id": 4, "total": 1.0, "items": [{"id": 8, "productId": 6, "quantity": 1.0, "product": {"id": 8, "name": "Mug"}}]})
    assert engine.get("Orders(4)/items")["value"][0]["productId"] in (6, 8)
    assert engine.get("Products(8)")["name"] == "Mug"
    with pytest.raises(ODataError) as e:
        engine.create("Orders", {"id": 4})
    assert e.value.status == 409
    mark = engine.get("Products(1)")["@odata.etag"]
    engine.update("Products", 1, {"price": 1.0}, if_match=mark)
    assert engine.get("Products(1)")["price"] == 1.0 and engine.get("Products(1)")["name"] == "Garden Spade"
    with pytest.raises(ODataError) as e:
        engine.update("Products", 1, {"price": 2.0}, if_match='W/"x"')
    assert e.value.status == 412
    engine.update("Products", 1, {"name": "L"}, replace=True)
    assert engine.get("Products(1)")["price"] is None
    engine.update("Orders", 1, {"items": [{"id": 1, "quantity": 9.0}, {"id": 99, "quantity": 1.0}]})
    assert engine.get("OrderItems(1)")["quantity"] == 9.0 and engine.get("OrderItems(99)")["orderId"] == 1
    engine.link("OrderItems", 1, "product", 2)
    assert engine.get("OrderItems(1)/product")["id"] == 2
    engine.unlink("OrderItems", 1, "product")
    assert engine.get("OrderItems(1)/product") is None
    engine.delete("Orders", 2)
    assert engine.get("OrderItems/$count?$filter=orderId eq 2") == 0
    with pytest.raises(ODataError):
        engine.delete("Orders", 2)


def test_restrict(engine, spark):
    engine.config.owned = {"OrderItems": ("notes",)}
    with pytest.raises(ODataError) as e:
        engine.delete("OrderItems", 4)
    assert e.value.status == 409
    engine.delete("OrderItems", 2)


def test_delta(engine):
    engine.config.page_size = 50
    link = engine.get("Products")["@odata.deltaLink"]
    assert engine.get(link)["value"] == []
    engine.create("Products", {"id": 20, "name": "New", "updatedAt": "2025-01-01 00:00:00"})
    engine.delete("Products", 3)
    value = engine.get(link)["value"]
    assert [r["id"] for r in value if "@removed" not in r] == [20] and [r["id"] for r in value if "@removed" in r] == [3]
    link = engine.get("OrderItems?$apply=groupby((orderId),aggregate($count as n))")["@odata.deltaLink"]
    engine.delete("OrderItems", 1)
    assert engine.get(link)["value"] == [{"orderId": 1, "n": 1}]
    engine.config.delta = False
    with pytest.raises(ODataError):
        engine.get(link)


def test_registry(spark):
    registry = Registry()

    @registry.function("cheap", binding="collection", entity_set="Products", params={"most": float})
    def cheap(spark, df, most):
        return df.filter(df.price <= most).select("id")

    @registry.action("ping")
    def ping(spark, df):
        return "pong"

    seen = []
    registry.hook("before", "READ", "Products")(lambda c: seen.append(c["set"]))
    registry.hook("on", "READ", "Orders")(lambda c: {"value": []})
    registry.executor(lambda c: c["set"] == "Nulls", lambda c: spark.createDataFrame([(1,)], "n int"))
    engine = Engine(catalog(spark), Config(secret="s"), registry)
    assert [r["id"] for r in engine.get("Products/cheap(most=30)")["value"]] == [2, 4, 6]
    assert engine.get("ping()")["value"] == "pong"
    assert engine.get("Products?$top=1") and seen == ["Products"]
    assert engine.get("Orders") == {"value": []}
    assert engine.get("Nulls?$apply=aggregate($count as n)")["value"] == [{"n": 1}]
    with pytest.raises(ODataError):
        engine.get("Products/cheap()")


def test_limits(spark):
    engine = Engine(catalog(spark), Config(secret="s", max_top=2))
    with pytest.raises(ODataError):
        engine.query("Products", "$top=3")
    lenient = Engine(catalog(spark), Config(secret="s", max_top=2, strict=False))
    assert lenient.query("Products", "$top=3").count() == 2


def test_raw_filter(engine):
    where = '{"where":{"or":[{"price":{"lt":10}},{"name":{"ilike":"%25lantern%25"}}]},"order":"id desc","fields":["id"]}'
    assert [r["id"] for r in engine.get(f"Products?filter={where}")["value"]] == [5, 2]


def test_batch(engine):
    out = run_batch(
        engine,
        [
            {"id": "a", "method": "GET", "url": "Products(1)"},
            {"id": "b", "method": "GET", "url": "Products(99)"},
            {"id": "c", "method": "GET", "url": "Products(2)", "dependsOn": ["b"]},
            {"id": "d", "method": "POST", "url": "Orders", "body": {"id": 9, "total": 1.0}},
            {"id": "e", "method": "GET", "url": "$d", "dependsOn": ["d"]},
            {"id": "f", "method": "DELETE", "url": "Orders(1)", "atomicityGroup": "g"},
            {"id": "h", "method": "DELETE", "url": "Orders(77)", "atomicityGroup": "g"},
        ],
    )
    assert [r["status"] for r in out] == [200, 404, 424, 201, 200, 424, 404]
    assert engine.get("Orders(1)")["total"] == 550.0


def test_values():
    from datetime import timedelta
    from decimal import Decimal

    assert duration(timedelta(days=1, hours=2, seconds=3.5)) == "P1DT2H3.5S" and duration(timedelta(0)) == "PT0S"
    assert plain(Decimal("1E+3")) == "1000" and plain(b"ab") == "YWI=" and plain(float("inf")) == "INF"


def test_navigation_gives_all_children(engine):
    for i in range(100, 107):
        engine.create("OrderItems", {"id": i, "orderId": 1})
    own = engine.catalog.frame("OrderItems").filter("orderId = 1").count()
    page = engine.get("Orders(1)/items?$count=true")
    assert own > engine.config.page_size and len(page["value"]) == page["@odata.count"] == own
    assert len(engine.get("Orders(1)/items?$top=2")["value"]) == 2


def test_delta_pages(engine):
    engine.config.page_size = 50
    link = engine.get("Products")["@odata.deltaLink"]
    for i in range(20, 27):
        engine.create("Products", {"id": i, "name": "New", "updatedAt": f"2025-01-{47 - i:02d} 00:00:00"})
    engine.delete("Products", 3)
    engine.config.page_size = 3
    seen, links = [], []
    while link:
        page = engine.get(link)
        seen += page["value"]
        links += [page["@odata.deltaLink"]] if "@odata.deltaLink" in page else []
        link = page.get("@odata.nextLink")
    assert [r["id"] for r in seen if "@removed" not in r] == list(range(20, 27)) and [r["id"] for r in seen if "@removed" in r] == [3]
    assert len(links) == 1 and engine.get(links[0])["value"] == []
    engine.create("Products", {"id": 30, "name": "New", "updatedAt": "2025-03-01 00:00:00"})
    assert [r["id"] for r in engine.get(links[0])["value"]] == [30]


def test_deletions_beyond_a_page(engine):
    engine.config.page_size, link = 2, None
    url = "Products"
    while url:
        page = engine.get(url)
        url, link = page.get("@odata.nextLink"), page.get("@odata.deltaLink")
    engine.delete("Products", 6)
    engine.delete("Products", 2)
    page = engine.get(link)
    assert sorted(r["id"] for r in page["value"] if r.get("@removed")) == [2, 6] == sorted(r["id"] for r in page["value"])
    url = "OrderItems?$apply=groupby((productId),aggregate($count as n))"
    while url:
        page = engine.get(url)
        url, link = page.get("@odata.nextLink"), page.get("@odata.deltaLink")
    engine.delete("OrderItems", 1)
    engine.delete("OrderItems", 2)
    changes = engine.get(link)["value"]
    assert [(r["productId"], r["n"]) for r in changes if "@removed" not in r] == [(4, 1)] and [r["productId"] for r in changes if "@removed" in r] == [3]


def test_limits_are_set_by_the_configuration(spark):
    from odarel.catalog import Limits

    tight = Engine(catalog(spark), Config(secret="s", limits=Limits(search_terms=1, expand_depth=1, joins=0, cascade=1), owned={"Orders": ("items",)}))
    for name, options in (("Products", "$search=a b"), ("Orders", "$expand=items($expand=product)"), ("OrderItems", "$filter=product/price gt 1")):
        with pytest.raises(ODataError):
            tight.query(name, options).count()
    with pytest.raises(ODataError):
        tight.delete("Orders", 1)


def test_search_inside_expand_and_plan_of_a_page(engine):
    got = engine.get("Orders?$expand=products($search=tent)")["value"]
    assert [[p["id"] for p in o["products"]] for o in got] == [[3, 4], [], [4]]
    plan = engine.query("Products", "$top=2&$expand=orderItems")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan.split("Aggregate", 1)[1]

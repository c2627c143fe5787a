import pytest

from odarel.errors import ODataError
from odarel.operators.query import query
from odarel.plans.parser import parse_options
from tests.shop import catalog


@pytest.fixture(scope="module")
def shop(spark):
    return catalog(spark)


def ids(shop, name, text, **more):
    return [r["id"] for r in query(shop, name, parse_options({"$filter": text, "$orderby": "id", **more})).collect()]


def rows(shop, name, **options):
    return [r.asDict(recursive=True) for r in query(shop, name, parse_options({f"${k}": v for k, v in options.items()})).collect()]


@pytest.mark.parametrize(
    "text,want",
    [
        ("x lt 6", [2, 3]),
        ("x ne 6", [2, 3]),
        ("x eq null", [1]),
        ("x ne null", [2, 3]),
        ("not (x lt 0)", [2]),
        ("f in (null,'X')", [1, 2]),
        ("not (f in (null,'X'))", [3]),
        ("not contains(f,'x')", [3]),
        ("concat(f,'-') eq '-'", [1]),
        ("round(x) eq -2", [3]),
        ("ceiling(x) eq -2", [3]),
        ("floor(x) eq -3", [3]),
        ("length(f) eq 1", [2, 3]),
        ("at eq 2024-01-01", [1, 3]),
        ("at eq datetimeoffset'2024-01-01T01:00:00+01:00'", [1, 3]),
        ("year(at) eq 2024 and month(at) eq 1 and hour(at) eq 0", [1, 3]),
        ("x div 0 eq null", [1, 2, 3]),
        ("x mod 2 eq -0.5", [3]),
        ("6 gt x", [2, 3]),
    ],
)
def test_nulls_and_numbers(shop, text, want):
    assert ids(shop, "Nulls", text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("contains(name,'LAN')", [5]),
        ("startswith(name,'tent') and endswith(name,'PEGS')", [4]),
        ("contains(name,'e_')", []),
        ("indexof(name,'tent') eq 6", [6]),
        ("indexof(name,'zz') eq -1", [1, 2, 3, 4, 5, 6]),
        ("substring(name,0,4) eq 'Tent'", [3, 4]),
        ("substring(name,5) eq 'Pegs'", [4]),
        ("dimensions/width gt 16", [1, 3, 4, 6]),
        ("orderItems/any(i: i/unitPrice gt 50) and price gt 100", [3]),
        ("orderItems/any()", [1, 2, 3, 4, 5]),
        ("orderItems/all(i: i/quantity gt 1)", [1, 2, 4, 6]),
        ("not orderItems/any(i: i/quantity gt 4)", [1, 3, 5, 6]),
        ("orderItems/any(i: i/quantity gt 9) or price gt 100", [3, 4]),
        ("orderItems/any(i: i/notes/any(n: n/text eq 'wrap twice'))", [5]),
        ("orders/any(o: o/total gt 500)", [3, 4]),
        ("orderItems/any(i: i/order/total lt 250)", [2, 4, 5]),
        ("between(price,10,45)", [1, 4, 6]),
    ],
)
def test_products(shop, text, want):
    assert ids(shop, "Products", text) == want


def test_paths(shop):
    assert ids(shop, "OrderItems", "product/name eq 'Lantern' and order/total lt 250") == [5]
    assert ids(shop, "OrderItems", "order/items/any(i: i/quantity eq 20)") == [1, 2]
    assert ids(shop, "Rules", "schema/when/land eq 'NZ' and schema/version ge 3") == [1]
    assert ids(shop, "MediaAssets", "big eq 9223372036854775807") == [1]


@pytest.mark.parametrize("text", ["nope eq 1", "price eq 'x'", "orderItems/quantity eq 1", "nope/any()", "dimensions/depth eq 1", "name/any()"])
def test_unknown(shop, text):
    with pytest.raises(ODataError):
        ids(shop, "Products", text)


def test_apply(shop):
    def run(name, text, **more):
        return rows(shop, name, apply=text, **more)

    assert run("OrderItems", "aggregate(quantity mul unitPrice with sum as r)") == [{"r": 1033.5}]
    nested = run("OrderItems", "concat(aggregate(quantity with sum as q),groupby((product/name),aggregate(quantity with sum as q))/concat(aggregate($count as c),top(3)))")
    assert len(nested) == 5 and nested[0]["q"] == 42 and [r["c"] for r in nested if r["c"]] == [5]
    totals = {r["id"]: r["q"] for r in run("Products", "groupby((id),aggregate(orderItems/quantity with sum as q))")}
    assert totals == {1: 2, 2: 5, 3: 1, 4: 30, 5: 4, 6: None}
    assert run("Orders", "groupby((total),aggregate(id with count as n))/aggregate(n with sum as all)") == [{"all": 3}]
    assert run("Nulls", "aggregate(x with sum as s,x with average as a,x with count as c,f with countdistinct as d,$count as n)") == [{"s": 2.5, "a": 1.25, "c": 2, "d": 2, "n": 3}]
    assert run("Nulls", "filter(id gt 99)/aggregate(x with sum as s,$count as n)") == [{"s": None, "n": 0}]
    assert [r["id"] for r in run("Products", "filter(price gt 11)/orderby(price desc)/skip(1)/top(2)")] == [5, 1]
    # a filter written after top still runs before it
    assert [r["id"] for r in run("Products", "orderby(price)/top(1)/filter(price gt 50)")] == [5]
    kept = run("OrderItems", "concat(aggregate(unitPrice with sum as price),aggregate($count as n))/filter(price ge 999999)")
    assert kept == [{"price": None, "n": 7}]
    for bad in ("aggregate(nope with sum as s)", "aggregate(x with sum as s)/filter(x gt 1)", "groupby((f),aggregate($count as f))", "top(1)/top(2)"):
        with pytest.raises(ODataError):
            run("Nulls", bad)


def test_order_and_nulls(shop):
    assert [r["id"] for r in rows(shop, "Nulls", orderby="x")] == [3, 2, 1]
    assert [r["id"] for r in rows(shop, "Nulls", orderby="x desc")] == [1, 2, 3]
    assert [r["id"] for r in rows(shop, "OrderItems", orderby="product/name desc,quantity", top="2")] == [6, 2]
    assert rows(shop, "Nulls", top="0") == []


def test_select_compute_search(shop):
    assert rows(shop, "Products", select="id,twice", compute="price mul 2 as twice", filter="id eq 1") == [{"id": 1, "twice": 84.0}]
    assert [r["id"] for r in rows(shop, "Products", search='tent NOT "spare tent"', orderby="id")] == [3, 4]
    assert [r["id"] for r in rows(shop, "Products", search="rope OR (pegs AND spare)", orderby="id")] == [2, 6]
    for bad in ({"select": "nope"}, {"compute": "price as name"}, {"search": "a b c d e f"}):
        with pytest.raises(ODataError):
            rows(shop, "Products", **bad)
    with pytest.raises(ODataError):
        rows(shop, "Orders", search="a")


def test_expand(shop):
    found = rows(shop, "Orders", expand="items($filter=quantity gt 2;$orderby=quantity desc;$expand=product($select=name);$select=quantity),products($top=1;$orderby=price desc;$select=id)", orderby="id")
    assert [i["quantity"] for i in found[2]["items"]] == [10.0, 5.0] and found[2]["items"][0]["product"]["name"] == "Tent Pegs"
    assert [[p["id"] for p in o["products"]] for o in found] == [[3], [5], [5]]
    assert [len(r["orderItems"]) for r in rows(shop, "Products", expand="orderItems", orderby="id")] == [1, 1, 1, 2, 2, 0]
    deep = rows(shop, "OrderItemNotes", expand="orderItem/order")
    assert deep[0]["orderItem"]["order"]["total"] == 258.0
    with pytest.raises(ODataError):
        rows(shop, "Orders", expand="nope")


def test_plan_is_pushed_down(spark, tmp_path):
    from odarel.catalog import Catalog, EntitySet
    from odarel.sources.tables import parquet

    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as pad").write.parquet(str(tmp_path / "t"))
    cat = Catalog(spark, [EntitySet("T", ("id",), parquet(str(tmp_path / "t")))])
    df = query(cat, "T", parse_options({"$filter": "k gt 3", "$select": "id"}))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(k,3)" in plan and "pad" not in plan.split("ReadSchema")[1]

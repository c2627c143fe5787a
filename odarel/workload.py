"""Entity sets over the sample tables, and the registered queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from odarel.catalog import Catalog, EntitySet, Relation
from odarel.operators import query as collection
from odarel.operators.delta import bucket_changes, changed_since, tombstones
from odarel.operators.paging import after
from odarel.operators.writes import upsert
from odarel.plans.parser import parse_options
from odarel.service.engine import Config, Engine
from odarel.sources.tables import parquet
from odarel.streaming.windows import sessions, tumbling


def sample_sets(sf_dir: str) -> list[EntitySet]:
    def table(name: str):
        return parquet(f"{sf_dir}/{name}.parquet")

    return [
        EntitySet("Regions", ("r_regionkey",), table("region"), searchable=("r_name",)).relate(Relation("nations", "Nations", "r_regionkey", "n_regionkey", "many")),
        EntitySet("Nations", ("n_nationkey",), table("nation"), searchable=("n_name",)).relate(
            Relation("region", "Regions", "n_regionkey", "r_regionkey"), Relation("customers", "Customers", "n_nationkey", "c_nationkey", "many"), Relation("suppliers", "Suppliers", "n_nationkey", "s_nationkey", "many")
        ),
        EntitySet("Customers", ("c_custkey",), table("customer"), searchable=("c_name", "c_mktsegment")).relate(
            Relation("nation", "Nations", "c_nationkey", "n_nationkey"), Relation("orders", "Orders", "c_custkey", "o_custkey", "many"), Relation("events", "Events", "c_custkey", "user_id", "many")
        ),
        EntitySet("Suppliers", ("s_suppkey",), table("supplier"), searchable=("s_name",)).relate(Relation("nation", "Nations", "s_nationkey", "n_nationkey"), Relation("lineitems", "LineItems", "s_suppkey", "l_suppkey", "many")),
        EntitySet("Parts", ("p_partkey",), table("part"), searchable=("p_name", "p_type", "p_brand")).relate(
            Relation("lineitems", "LineItems", "p_partkey", "l_partkey", "many"), Relation("orders", "Orders", "p_partkey", "o_orderkey", "many", "LineItems", "l_partkey", "l_orderkey")
        ),
        EntitySet("Orders", ("o_orderkey",), table("orders"), searchable=("o_orderpriority", "o_orderstatus"), delta="o_orderdate").relate(
            Relation("customer", "Customers", "o_custkey", "c_custkey"),
            Relation("lineitems", "LineItems", "o_orderkey", "l_orderkey", "many"),
            Relation("parts", "Parts", "o_orderkey", "p_partkey", "many", "LineItems", "l_orderkey", "l_partkey"),
        ),
        EntitySet("LineItems", ("l_orderkey", "l_linenumber"), table("lineitem")).relate(
            Relation("order", "Orders", "l_orderkey", "o_orderkey"), Relation("part", "Parts", "l_partkey", "p_partkey"), Relation("supplier", "Suppliers", "l_suppkey", "s_suppkey")
        ),
        EntitySet("Events", ("event_id",), table("events"), searchable=("event_type",), json={"props": {"k": "double"}}, delta="ts").relate(Relation("customer", "Customers", "user_id", "c_custkey")),
        EntitySet("Documents", ("doc_id",), table("documents"), searchable=("text",)).relate(Relation("labels", "Labels", "doc_id", "doc_id", "many")),
        EntitySet("Labels", ("doc_id",), table("labels")).relate(Relation("document", "Documents", "doc_id", "doc_id")),
        EntitySet("Pages", ("page_id",), table("pages"), searchable=("url",)),
        EntitySet("Benchmark", ("item_id",), table("benchmark"), searchable=("text",)),
        EntitySet("Conversations", ("conv_id", "turn"), table("conversations"), searchable=("text",)),
        EntitySet("Embeddings", ("vec_id",), table("embeddings")),
    ]


def sample_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sample_sets(sf_dir))


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
PART = "p_partkey, p_name, p_brand, p_type, p_size, p_retailprice"
CUST = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"
EVENT = "event_id, ts, user_id, event_type, value, props"

#: name: (set and options, SQL)
QUERIES: dict[str, tuple[str, str]] = {
    "f_compare": ("Orders?$filter=o_totalprice ge 100000 and o_orderstatus eq 'F'", f"SELECT {ORDER} FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus = 'F'"),
    "f_or_paren": ("Orders?$filter=(o_totalprice lt 5000 or o_totalprice gt 400000) and o_orderstatus ne 'O'&$select=o_orderkey,o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice < 5000 OR o_totalprice > 400000) AND o_orderstatus <> 'O'"),
    "f_null": ("Customers?$filter=c_mktsegment ne null and not (c_acctbal eq null)&$select=c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND NOT (c_acctbal IS NULL)"),
    "f_in": ("Customers?$filter=c_mktsegment in ('BUILDING',null)&$select=c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL"),
    "f_not_in": ("Customers?$filter=not (c_mktsegment in ('BUILDING','MACHINERY'))", f"SELECT {CUST} FROM customer WHERE c_mktsegment NOT IN ('BUILDING','MACHINERY')"),
    "f_not_and": ("Orders?$filter=not (o_totalprice gt 100000 and o_orderstatus eq 'F')&$select=o_orderkey", "SELECT o_orderkey FROM orders WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'F')"),
    "f_contains": ("Parts?$filter=contains(p_type,'con')", f"SELECT {PART} FROM part WHERE p_type ILIKE '%con%'"),
    "f_starts_ends": ("Parts?$filter=startswith(p_type,'PROMO') or endswith(p_name,'1')&$select=p_partkey", "SELECT p_partkey FROM part WHERE p_type ILIKE 'PROMO%' OR p_name ILIKE '%1'"),
    "f_contains_folded": ("Parts?$filter=contains(tolower(p_type),'CON') and contains(toupper(p_brand),'brand')&$select=p_partkey", "SELECT p_partkey FROM part WHERE p_type ILIKE '%con%' AND p_brand ILIKE '%brand%'"),
    "f_tolower": ("Customers?$filter=tolower(c_mktsegment) eq 'building'", f"SELECT {CUST} FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "f_toupper": ("Regions?$filter=toupper(r_name) ne 'ASIA'", "SELECT r_regionkey, r_name FROM region WHERE upper(r_name) <> 'ASIA'"),
    "f_trim": ("Customers?$filter=trim(c_mktsegment) eq 'BUILDING'&$select=c_custkey", "SELECT c_custkey FROM customer WHERE trim(c_mktsegment) = 'BUILDING'"),
    "f_concat": ("Customers?$filter=concat(c_mktsegment,'-',c_name) eq 'BUILDING-Customer#000000007' or concat(c_mktsegment,c_mktsegment) eq 'BUILDINGBUILDING'&$select=c_custkey", "SELECT c_custkey FROM customer WHERE concat(c_mktsegment,'-',c_name) = 'BUILDING-Customer#000000007' OR concat(c_mktsegment,c_mktsegment) = 'BUILDINGBUILDING'"),
    "f_datepart": ("Events?$filter=hour(ts) lt 6 and year(ts) eq 2024", f"SELECT {EVENT} FROM events WHERE date_part('hour', ts) < 6 AND date_part('year', ts) = 2024"),
    "f_dateparts": ("Events?$filter=month(ts) eq 1 and day(ts) ge 10 and minute(ts) lt 30 and second(ts) ge 15&$select=event_id", "SELECT event_id FROM events WHERE date_part('month', ts) = 1 AND date_part('day', ts) >= 10 AND date_part('minute', ts) < 30 AND floor(date_part('second', ts)) >= 15"),
    "f_year_range": ("Orders?$filter=year(o_orderdate) ge 1997 and year(o_orderdate) ne 1998&$select=o_orderkey", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1997 AND year(o_orderdate) <> 1998"),
    "f_datetime": ("LineItems?$filter=l_shipdate ge 1997-01-01 and l_shipdate lt 1997-02-01T00:00:00Z&$select=l_orderkey,l_partkey,l_suppkey", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-02-01'"),
    "f_round": ("LineItems?$filter=round(l_quantity div 2) eq 3&$select=l_orderkey,l_quantity", "SELECT l_orderkey, l_quantity FROM lineitem WHERE floor(l_quantity / 2 + 0.5) = 3"),
    "f_floor": ("LineItems?$filter=floor(l_quantity) eq 10&$select=l_orderkey,l_partkey,l_quantity", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE floor(l_quantity) = 10"),
    "f_ceiling": ("Parts?$filter=ceiling(p_retailprice) le 1000&$select=p_partkey,p_retailprice", "SELECT p_partkey, p_retailprice FROM part WHERE ceil(p_retailprice) <= 1000"),
    "f_indexof": ("Parts?$filter=indexof(p_type,'o') ge 2 and indexof(p_brand,'#') gt -1&$select=p_partkey", "SELECT p_partkey FROM part WHERE instr(lower(p_type), 'o') - 1 >= 2 AND instr(lower(p_brand), '#') - 1 > -1"),
    "f_substr_len": ("Parts?$filter=substring(p_brand,0,5) eq 'Brand' and length(p_brand) eq 7", f"SELECT {PART} FROM part WHERE substr(p_brand,1,5) = 'Brand' AND length(p_brand) = 7"),
    "f_substr_tail": ("Parts?$filter=substring(p_brand,6) eq '1'&$select=p_partkey,p_brand", "SELECT p_partkey, p_brand FROM part WHERE substr(p_brand, 7) = '1'"),
    "f_between_like": ("Parts?$filter=between(p_size,10,20) and ilike(p_type,'%o%')&$select=p_partkey", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type ILIKE '%o%'"),
    "f_nav": ("Orders?$filter=customer/nation/region/r_name eq 'ASIA'", f"SELECT {ORDER} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "f_structured": ("Events?$filter=props/k gt 50", f"SELECT {EVENT} FROM events WHERE cast(json_extract_string(props, '$.k') AS double) > 50"),
    "l_any": ("Orders?$filter=lineitems/any(l: l/l_quantity gt 45)", f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)"),
    "l_any_empty": ("Orders?$filter=lineitems/any()&$select=o_orderkey", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "l_all": ("Orders?$filter=lineitems/all(l: l/l_quantity gt 5)", f"SELECT {ORDER} FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_quantity > 5) IS NOT TRUE)"),
    "l_not_any_or": ("Orders?$filter=not lineitems/any(l: l/l_discount gt 0.05) or o_totalprice gt 400000", f"SELECT {ORDER} FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.05) OR o_totalprice > 400000"),
    "l_not_all": ("Orders?$filter=not lineitems/all(l: l/l_quantity gt 5)&$select=o_orderkey", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 5))"),
    "l_nested": ("Customers?$filter=orders/any(o: o/o_orderstatus eq 'F' and o/lineitems/any(l: l/l_quantity gt 49))", f"SELECT {CUST} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49))"),
    "l_multi_segment": ("Customers?$filter=orders/lineitems/any(l: l/l_quantity gt 49)&$select=c_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49)"),
    "l_through": ("Orders?$filter=parts/any(p: p/p_size gt 48)", f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND p_size > 48)"),
    "l_inner_nav": ("Orders?$filter=lineitems/any(l: l/part/p_size eq 50 and contains(l/supplier/s_name,'1'))&$select=o_orderkey", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND p_size = 50 AND s_name ILIKE '%1%')"),
    "a_group": ("LineItems?$apply=groupby((l_returnflag,l_linestatus),aggregate(l_quantity with sum as q,l_quantity with max as hi,l_quantity with min as lo,$count as n,l_partkey with countdistinct as p,l_suppkey with count as s))", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q, max(l_quantity) AS hi, min(l_quantity) AS lo, count(*) AS n, count(DISTINCT l_partkey) AS p, count(l_suppkey) AS s FROM lineitem GROUP BY 1, 2"),
    "a_flagship": ("LineItems?$filter=l_shipdate lt datetimeoffset'1998-09-02T00:00:00Z'&$apply=groupby((l_returnflag,l_linestatus),aggregate(l_quantity with sum as sum_qty,l_quantity with average as avg_qty,$count as n))", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "a_global": ("Orders?$apply=filter(o_totalprice gt 99999999)/aggregate($count as n,o_custkey with sum as s,o_custkey with countdistinct as d)", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS s, count(DISTINCT o_custkey) AS d FROM orders WHERE o_totalprice > 99999999"),
    "a_having_top": ("Orders?$apply=groupby((o_custkey),aggregate(o_totalprice with max as t,$count as n))/filter(n ge 12)/orderby(n desc,o_custkey)/top(10)", "SELECT o_custkey, max(o_totalprice) AS t, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12 ORDER BY n DESC, o_custkey LIMIT 10"),
    "a_skip_top": ("Orders?$apply=groupby((o_custkey),aggregate($count as n))/orderby(o_custkey desc)/skip(20)/top(5)", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY o_custkey DESC LIMIT 5 OFFSET 20"),
    "a_plain": ("Orders?$apply=filter(o_orderstatus eq 'P')/orderby(o_totalprice desc)/skip(3)/top(7)", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3"),
    "a_nav_group": ("Orders?$apply=groupby((customer/nation/n_name),aggregate($count as n))", 'SELECT n_name AS "customer/nation/n_name", count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1'),
    "a_nav_many": ("Customers?$apply=groupby((c_mktsegment),aggregate(orders/o_orderkey with count as n,orders/o_orderkey with max as last))", "SELECT c_mktsegment, count(o_orderkey) AS n, max(o_orderkey) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "a_chain": ("Orders?$apply=groupby((o_custkey),aggregate($count as n))/groupby((n),aggregate($count as customers))", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1"),
    "a_computed": ("LineItems?$apply=groupby((l_linestatus),aggregate(l_quantity mul l_linenumber with sum as units))", "SELECT l_linestatus, sum(l_quantity * l_linenumber) AS units FROM lineitem GROUP BY 1"),
    "a_concat": ("Orders?$apply=concat(aggregate($count as n),groupby((o_orderstatus),aggregate($count as n)))", "SELECT NULL::VARCHAR AS o_orderstatus, count(*) AS n FROM orders UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1"),
    "a_concat_filter": ("Orders?$apply=concat(aggregate($count as total),groupby((o_orderstatus),aggregate($count as n)))/filter(n gt 1000)", "SELECT NULL::BIGINT AS n, NULL::VARCHAR AS o_orderstatus, count(*) AS total FROM orders UNION ALL SELECT count(*) AS n, o_orderstatus, NULL FROM orders GROUP BY 2 HAVING count(*) > 1000"),
    "a_price_bench": ("Parts?$apply=filter(p_retailprice gt 200)/groupby((p_size),aggregate(p_partkey with count as n))/orderby(n desc,p_size)/top(10)", "SELECT p_size, count(p_partkey) AS n FROM part WHERE p_retailprice > 200 GROUP BY 1 ORDER BY n DESC, p_size LIMIT 10"),
    "c_compute": ("LineItems?$compute=l_extendedprice div l_quantity as unit,l_linenumber mod 2 as odd,l_quantity add 1 sub 2 mul 3 as num&$select=l_orderkey,l_partkey", "SELECT l_orderkey, l_partkey, l_extendedprice / nullif(l_quantity, 0) AS unit, l_linenumber % 2 AS odd, l_quantity + 1 - 6 AS num FROM lineitem"),
    "c_compute_text": ("Nations?$compute=concat(tolower(n_name),'/',region/r_name) as label&$select=n_nationkey", "SELECT n_nationkey, concat(lower(n_name), '/', r_name) AS label FROM nation LEFT JOIN region ON n_regionkey = r_regionkey"),
    "s_search": ("Parts?$search=promo NOT \"Brand#1\"", f"SELECT {PART} FROM part WHERE (p_name ILIKE '%promo%' OR p_type ILIKE '%promo%' OR p_brand ILIKE '%promo%') AND NOT (p_name ILIKE '%Brand#1%' OR p_type ILIKE '%Brand#1%' OR p_brand ILIKE '%Brand#1%')"),
    "s_search_or": ("Parts?$search=(promo OR economy) AND 1&$filter=p_size lt 25&$select=p_partkey", "SELECT p_partkey FROM part WHERE (concat_ws('|', p_name, p_type, p_brand) ILIKE '%promo%' OR concat_ws('|', p_name, p_type, p_brand) ILIKE '%economy%') AND concat_ws('|', p_name, p_type, p_brand) ILIKE '%1%' AND p_size < 25"),
    "o_orderby": ("Orders?$orderby=o_orderstatus desc,o_totalprice&$top=25&$skip=10&$select=o_orderkey,o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 25 OFFSET 10"),
    "o_nav": ("Orders?$orderby=customer/c_name desc,o_orderkey&$top=20&$select=o_orderkey", "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY c_name DESC, o_orderkey LIMIT 20"),
    "k_lookup": ("Orders?$filter=o_orderkey eq 7", f"SELECT {ORDER} FROM orders WHERE o_orderkey = 7"),
}


def run_text(catalog: Catalog, text: str) -> DataFrame:
    name, _, options = text.partition("?")
    pairs = dict(part.split("=", 1) for part in options.split("&$") if part)
    return collection.query(catalog, name, parse_options({k if k.startswith("$") else f"${k}": v for k, v in pairs.items()}))


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_text(sample_catalog(spark, sf_dir), QUERIES[name][0])


def e_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_text(sample_catalog(spark, sf_dir), "Customers?$expand=orders&$select=c_custkey")
    return df.select("c_custkey", F.size("orders").cast("long").alias("n"), F.aggregate("orders", F.lit(0).cast("long"), lambda s, o: s + o["o_orderkey"]).alias("keys"))


def e_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_text(sample_catalog(spark, sf_dir), "Customers?$expand=orders($orderby=o_totalprice desc,o_orderkey;$top=2;$select=o_orderkey,o_totalprice)&$select=c_custkey")
    return df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey", "o.o_totalprice")


def e_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_text(sample_catalog(spark, sf_dir), "Orders?$expand=customer($expand=nation),lineitems($filter=l_quantity gt 10;$expand=part)&$select=o_orderkey")
    return df.select("o_orderkey", F.col("customer.nation.n_name").alias("n_name"), F.aggregate("lineitems", F.lit(0).cast("long"), lambda s, x: s + x["part"]["p_size"]).alias("sizes"))


def e_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_text(sample_catalog(spark, sf_dir), "Regions?$expand=nations($search=2;$orderby=n_name)&$select=r_regionkey")
    return df.select("r_regionkey", F.explode("nations").alias("n")).select("r_regionkey", "n.n_name")


def e_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children of a page's rows only."""
    df = run_text(sample_catalog(spark, sf_dir), "Customers?$orderby=c_acctbal desc&$top=50&$expand=orders&$select=c_custkey")
    return df.select("c_custkey", F.explode("orders").alias("o")).select("c_custkey", "o.o_orderkey")


def e_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set that relates to itself: nations by the number that their region has, three levels down."""
    catalog = sample_catalog(spark, sf_dir)
    catalog.get("Nations").relate(Relation("below", "Nations", "n_nationkey", "n_regionkey", "many"))
    df = run_text(catalog, "Nations?$expand=below($levels=2)&$select=n_nationkey")
    df = df.select("n_nationkey", F.explode("below").alias("a")).select("n_nationkey", F.col("a.n_nationkey").alias("first"), F.explode("a.below").alias("b"))
    return df.select("n_nationkey", "first", F.col("b.n_nationkey").alias("second"))


def _followed(engine: Engine, url: str, link: str = "@odata.nextLink") -> Iterator[dict]:
    """The rows of all pages."""
    while url:
        page = engine.get(url)
        yield from page["value"]
        url = page.get(link)


def _columns(spark: SparkSession, rows: Iterator[tuple], schema: str) -> DataFrame:
    """Rows that a client has gathered; as columns, so that the driver doesn't hold an object for each value."""
    fields = StructType.fromDDL(schema)
    names = to_arrow_schema(fields)
    parts = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), names, strict=True)], schema=names) for part in batched(rows, 10_000)]
    return spark.createDataFrame(pa.Table.from_batches(parts, names), fields)


def l_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, by following the links of signed tokens from page to page."""
    engine = _engine(spark, sf_dir, page_size=400)
    rows = _followed(engine, "/odata/Customers?$orderby=c_mktsegment desc,c_acctbal&$select=c_custkey,c_mktsegment&$count=true")
    return _columns(spark, ((int(r["c_custkey"]), r["c_mktsegment"], n) for n, r in enumerate(rows)), "c_custkey long, c_mktsegment string, nth long")


def d_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client learns of customers changed and deleted since it read them all, over several pages."""
    engine = _engine(spark, sf_dir, page_size=300, delta=True)
    customers = engine.catalog.get("Customers")
    frame = engine.catalog.frame("Customers").withColumn("changed", F.lit(1))
    customers.delta = "changed"
    engine.catalog.replace("Customers", frame)
    url, link = "/odata/Customers?$select=c_custkey", None
    while url:
        page = engine.get(url)
        url, link = page.get("@odata.nextLink"), page.get("@odata.deltaLink")
    later = frame.filter("c_custkey % 5 <> 0").withColumn("changed", F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(1))
    engine.catalog.replace("Customers", later)
    return _columns(spark, ((int(r["c_custkey"]), "@removed" in r) for r in _followed(engine, link)), "c_custkey long, removed boolean")


def p_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = sample_catalog(spark, sf_dir)
    done = collection.plan(catalog, "Orders", parse_options({"$orderby": "o_totalprice desc"}))
    done.scope.df_filter(after(done.scope, done.orders, [150000.0, 10]))
    by = done.sorted()
    return done.shown(done.scope.df.orderBy(*by).limit(50)).select("o_orderkey", "o_totalprice")


def c_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_text(sample_catalog(spark, sf_dir), "Orders?$filter=o_totalprice gt 200000&$search=urgent").agg(F.count(F.lit(1)).alias("n"))


def d_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = sample_catalog(spark, sf_dir)
    return changed_since(catalog, "Events", "2024-01-29T00:00:00Z").select("event_id", "event_type")


def d_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = sample_catalog(spark, sf_dir).frame("Orders")
    return tombstones(orders.select("o_orderkey"), orders.filter("o_orderkey % 7 <> 0"), ["o_orderkey"]).select("o_orderkey")


def t_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(sample_catalog(spark, sf_dir).frame("Events"), "ts", "1 day", ["event_type"])


def t_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(sample_catalog(spark, sf_dir).frame("Events"), "ts", "2 days", ["event_type"], slide="1 day")


def t_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(sample_catalog(spark, sf_dir).frame("Events"), "ts", "6 hours", ["user_id"])
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


def _engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    return Engine(sample_catalog(spark, sf_dir), Config(secret="sample", **options))


def d_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that changed or went when some orders did."""
    catalog = sample_catalog(spark, sf_dir)
    text = "$apply=groupby((o_orderpriority,o_orderstatus),aggregate($count as n))"
    before = run_text(catalog, f"Orders?{text}")
    catalog.replace("Orders", catalog.frame("Orders").filter("o_orderstatus <> 'P' and not (o_orderpriority like '1%' and o_orderkey % 3 = 0)"))
    return bucket_changes(before, run_text(catalog, f"Orders?{text}"), ["o_orderpriority", "o_orderstatus"]).withColumnRenamed("@removed", "removed")


def n_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).navigation("Customers", 7, "orders", "$filter=o_totalprice gt 1000&$orderby=o_totalprice desc").select("o_orderkey", "o_totalprice")


def n_read_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).navigation("Orders", 7, "customer").select("c_custkey", "c_name")


def n_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).navigation("Orders", 7, "parts").select("p_partkey", "p_size")


def k_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir).entity("Customers", 7).select("c_name")


def k_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.singleton("Home", "Nations", lambda: 7)
    return engine.entity("Home")


def r_raw_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {"where": {"or": [{"o_totalprice": {"between": [1000, 5000]}}, {"o_orderpriority": {"ilike": "%urgent%"}}], "o_orderstatus": {"nin": ["P"]}}, "fields": ["o_orderkey"], "order": "o_orderkey"}
    return _engine(spark, sf_dir).query("Orders", raw_filter=raw)


def u_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)

    @engine.registry.function("largest", binding="collection", entity_set="Orders", params={"least": float})
    def largest(spark, df, least):
        return df.filter(F.col("o_totalprice") >= least).select("o_orderkey")

    return engine.call("largest", "Orders", least=300000)


def _written(change: Callable[[Engine], None], name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir, owned={"Customers": ("orders",), "Orders": ("lineitems",)})
        change(engine)
        return engine.catalog.frame(name)

    return run


def _cascade(engine: Engine) -> None:
    orders = engine.catalog.get("Orders")
    orders.relations["lineitems"] = replace(orders.relations["lineitems"], on_delete="cascade")
    engine.delete("Orders", 7)


def w_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = sample_catalog(spark, sf_dir).frame("Nations")
    rows = nations.filter("n_nationkey < 3").withColumn("n_name", F.upper("n_name")).union(nations.limit(0))
    return upsert(nations, ("n_nationkey",), rows.withColumn("n_regionkey", F.lit(0)))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text("a_flagship")(spark, sf_dir)


CODED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "e_count": (e_count, "SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "e_top": (e_top, "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "e_nested": (e_nested, "SELECT o_orderkey, n_name, coalesce((SELECT sum(p_size) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND l_quantity > 10), 0)::BIGINT AS sizes FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "e_search": (e_search, "SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_name ILIKE '%2%'"),
    "e_page": (e_page, "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50) JOIN orders ON o_custkey = c_custkey"),
    "e_levels": (e_levels, "SELECT a.n_nationkey, b.n_nationkey AS first, c.n_nationkey AS second FROM nation a JOIN nation b ON b.n_regionkey = a.n_nationkey JOIN nation c ON c.n_regionkey = b.n_nationkey"),
    "l_pages": (l_pages, "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) - 1 AS nth FROM customer"),
    "d_feed": (d_feed, "SELECT c_custkey, c_custkey % 5 = 0 AS removed FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 2 = 0"),
    "p_keyset": (p_keyset, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "c_count": (c_count, "SELECT count(*) AS n FROM orders WHERE o_totalprice > 200000 AND (o_orderpriority ILIKE '%urgent%' OR o_orderstatus ILIKE '%urgent%')"),
    "d_delta": (d_delta, "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-29'"),
    "d_tombstones": (d_tombstones, "SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0"),
    "d_buckets": (d_buckets, "WITH b AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), a AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND NOT (o_orderpriority LIKE '1%' AND o_orderkey % 3 = 0) GROUP BY 1, 2) SELECT *, NULL::VARCHAR AS removed FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'deleted' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_orderpriority = b.o_orderpriority AND a.o_orderstatus = b.o_orderstatus)"),
    "t_sliding": (t_sliding, "SELECT window_start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])::TIMESTAMP AS window_start, event_type FROM events) GROUP BY 1, 2"),
    "t_sessions": (t_sessions, "WITH g AS (SELECT user_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM events) SELECT user_id, sum(begins)::BIGINT AS sessions, count(*) AS n FROM g GROUP BY 1"),
    "n_read": (n_read, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000"),
    "n_read_one": (n_read_one, "SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 7)"),
    "n_read_through": (n_read_through, "SELECT p_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 7"),
    "k_property": (k_property, "SELECT c_name FROM customer WHERE c_custkey = 7"),
    "k_singleton": (k_singleton, "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 7"),
    "r_raw_filter": (r_raw_filter, "SELECT o_orderkey FROM orders WHERE (o_totalprice BETWEEN 1000 AND 5000 OR o_orderpriority ILIKE '%urgent%') AND o_orderstatus <> 'P'"),
    "u_function": (u_function, "SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000"),
    "w_create": (_written(lambda e: e.create("Regions", {"r_regionkey": 99, "r_name": "NEW", "nations": [{"n_nationkey": 990, "n_name": "N1"}, {"n_nationkey": 991, "n_name": "N2"}]}), "Nations"), "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (990, 'N1', 99), (991, 'N2', 99)"),
    "w_patch": (_written(lambda e: e.update("Regions", 1, {"r_name": "PATCHED"}), "Regions"), "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'PATCHED' ELSE r_name END AS r_name FROM region"),
    "w_replace": (_written(lambda e: e.update("Nations", 3, {"n_name": "ONLY"}, replace=True), "Nations"), "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'ONLY' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation"),
    "w_deep_update": (_written(lambda e: e.update("Regions", 1, {"nations": [{"n_nationkey": 0, "n_name": "MOVED"}, {"n_nationkey": 99, "n_name": "ADDED"}]}), "Nations"), "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'MOVED' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 0 THEN 1 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (99, 'ADDED', 1)"),
    "w_delete": (_written(lambda e: e.delete("Nations", 5), "Nations"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 5"),
    "w_cascade": (_written(_cascade, "LineItems"), "SELECT * FROM lineitem WHERE l_orderkey <> 7"),
    "w_link": (_written(lambda e: e.link("Nations", 2, "region", 4), "Nations"), "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 2 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "w_unlink": (_written(lambda e: e.unlink("Regions", 1, "nations", 2), "Nations"), "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 2 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation"),
    "w_upsert": (w_upsert, "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN upper(n_name) ELSE n_name END AS n_name, CASE WHEN n_nationkey < 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation"),
    "t_tumbling": (t_tumbling, "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _text(name) for name in QUERIES} | {name: f for name, (f, _) in CODED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()} | {name: sql for name, (_, sql) in CODED.items()}

"""A small shop for campers: six products, three orders, seven items. All rows are invented for these tests."""

from datetime import datetime

from odarel.catalog import Catalog, EntitySet, Relation
from odarel.sources.tables import memory

PRODUCTS = [
    (1, "Garden Spade", 42.0, (18.0, 110.0)),
    (2, "Rope", 9.5, (4.0, 900.0)),
    (3, "Tent Large", 310.0, (420.0, 35.0)),
    (4, "Tent Pegs", 12.0, (30.0, 6.0)),
    (5, "Lantern", 58.0, (14.0, 26.0)),
    (6, "Spare Tent Pegs", 11.0, (30.0, 6.0)),
]
ITEMS = [(1, 1, 3, 1.0, 310.0), (2, 1, 4, 20.0, 12.0), (3, 2, 1, 2.0, 42.0), (4, 2, 5, 3.0, 58.0), (5, 3, 5, 1.0, 58.0), (6, 3, 4, 10.0, 12.0), (7, 3, 2, 5.0, 9.5)]
#: 310 + 240, 84 + 174, 58 + 120 + 47.5
ORDERS = [(1, 550.0), (2, 258.0), (3, 225.5)]


def sets():
    stamp = datetime(2024, 1, 1)
    return [
        EntitySet("Products", ("id",), memory([(i, n, p, datetime(2024, 1, i), d) for i, n, p, d in PRODUCTS], "id long, name string, price double, updatedAt timestamp, dimensions struct<width:double,height:double>"), searchable=("name",), etag="updatedAt", delta="updatedAt").relate(
            Relation("orderItems", "OrderItems", "id", "productId", "many"), Relation("orders", "Orders", "id", "id", "many", "OrderItems", "productId", "orderId")
        ),
        EntitySet("Orders", ("id",), memory(ORDERS, "id long, total double")).relate(
            Relation("items", "OrderItems", "id", "orderId", "many", on_delete="cascade"), Relation("products", "Products", "id", "id", "many", "OrderItems", "orderId", "productId")
        ),
        EntitySet("OrderItems", ("id",), memory(ITEMS, "id long, orderId long, productId long, quantity double, unitPrice double")).relate(
            Relation("order", "Orders", "orderId", "id"), Relation("product", "Products", "productId", "id"), Relation("notes", "OrderItemNotes", "id", "orderItemId", "many")
        ),
        EntitySet("OrderItemNotes", ("id",), memory([(1, 4, "wrap twice")], "id long, orderItemId long, text string")).relate(Relation("orderItem", "OrderItems", "orderItemId", "id")),
        EntitySet("MediaAssets", ("id",), memory([(1, "logo", bytearray(b"\x00\x01"), 9223372036854775807)], "id long, name string, data binary, big long")),
        EntitySet("Rules", ("id",), memory([(1, '{"version":4,"when":{"land":"NZ"}}')], "id long, schema string"), json={"schema": {"version": "int", "when/land": "string"}}),
        EntitySet("Nulls", ("id",), memory([(1, None, None, stamp), (2, 5.0, "X", None), (3, -2.5, "Y", stamp)], "id long, x double, f string, at timestamp")),
    ]


def catalog(spark):
    return Catalog(spark, sets())

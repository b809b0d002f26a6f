"""Nested order events: building them for tests, and taking them apart into canonical tables.

An event is a JSON document with an order, its customer and restaurant, items with add-ons, taxes and
discounts. Events may come again; the one with the greatest stream_id stands for its order, and lines
are keyed by order and position, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.functions.scalars import parsed_time
from comanda.functions.text import identity_key, normal_text
from comanda.session import spread
from comanda.sources.adapter import Shop
from comanda.streaming.incremental import latest

#: Fixed names of the order's further fields. Amounts come as numbers or texts and are read as texts.
_TEXTS = ("order_type", "sub_order_type", "order_from_id", "biller", "assignee", "table_no", "token_no", "customer_invoice_id", "comment")
_AMOUNTS = ("core_total", "tax_total", "discount_total", "delivery_charges", "packaging_charge", "service_charge", "round_off")
_HEADER = ", ".join(f"{c}: string" for c in (*_TEXTS, "no_of_persons", *_AMOUNTS))
_LINE = "itemid: bigint, quantity: double, price: double, total: double"
_PROPERTIES = {
    "Order": f"struct<orderID: bigint, created_on: string, total: double, order_from: string, status: string, {_HEADER}>", "Customer": "struct<name: string, phone: string, address: string>", "Restaurant": "struct<restID: string, res_name: string>",
    "OrderItem": f"array<struct<{_LINE}, addon: array<struct<{_LINE}>>>>", "Tax": "array<struct<title: string, rate: double, amount: double>>", "Discount": "array<struct<title: string, amount: double>>",
}
#: What counters of customers need.
_BRIEF = {"Order": "struct<orderID: bigint, created_on: string, total: double>", "Customer": _PROPERTIES["Customer"]}


def _event(properties: dict[str, str]) -> str:
    inner = ", ".join(f"{k}: {v}" for k, v in properties.items())
    return f"stream_id bigint, event_id string, aggregate_id string, occurred_at string, raw_event struct<raw_payload: struct<properties: struct<{inner}>>>"


EVENT = _event(_PROPERTIES)
REPLAYS = "order_id % 5 = 0"


def _line_list(lines: DataFrame, n: int, name: str) -> DataFrame:
    line = F.struct("line_no", F.col("menu_item_id").alias("itemid"), "quantity", F.col("unit_price").alias("price"), F.col("total_price").alias("total"))
    return spread(lines, n, "order_id").groupBy("order_id").agg(F.sort_array(F.collect_list(line)).alias(name))


def order_feed(shop: Shop) -> DataFrame:
    """stream_id, payload: an event for each order, and a second one for some, with one more in total."""
    made = F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss")
    rows = spread(shop.orders.join(shop.customers.select("customer_id", "name"), "customer_id"), shop.n_lines, "order_id")  # documents are the work here
    rows = rows.join(_line_list(shop.items, shop.n_lines, "lines"), "order_id", "left").join(_line_list(shop.addons, shop.n_lines, "extras"), "order_id", "left")
    plain = lambda x: F.transform(x, lambda i: i.dropFields("line_no"))
    item = F.transform("lines", lambda x, k: x.dropFields("line_no").withField("addon", F.when(k == 0, F.coalesce(plain(F.col("extras")), F.array()))))
    phone = F.when(F.col("customer_id") % 3 == 0, F.format_string("+91 98%08d", F.col("customer_id") - F.col("customer_id") % 2))
    street = F.concat(F.lit("  Street  "), (F.col("order_id") % 3).cast("string"))
    address = F.when(F.col("customer_id") % 3 != 2, F.when(F.col("order_id") % 2 == 0, F.upper(street)).otherwise(street))
    tax = lambda title: F.struct(F.lit(title).alias("title"), F.lit(2.5).alias("rate"), (F.col("total") * 0.025).alias("amount"))
    discount = F.when(F.col("order_id") % 4 == 0, F.array(F.struct(F.lit("Welcome").alias("title"), F.lit(10.0).alias("amount")))).otherwise(F.array())
    times = F.explode(F.when(F.expr(REPLAYS), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    events = rows.withColumn("again", times).withColumn("total", F.when(F.col("again") == 1, F.col("total") + 1).otherwise(F.col("total")))
    i = F.col("order_id")
    table = F.when(i % 3 == 0, (i % 20).cast("string"))
    kind = F.when(i % 3 == 0, "Dine In").when(i % 3 == 1, "Delivery").otherwise("Pick Up")
    header = {
        "order_type": kind, "sub_order_type": F.when(i % 3 == 0, "AC"), "order_from_id": i.cast("string"), "biller": F.concat(F.lit("biller "), (i % 7).cast("string")), "table_no": table, "token_no": (i % 100).cast("string"),
        "customer_invoice_id": F.concat_ws("-", "customer_id", "order_id"), "comment": F.when(F.col("again") == 1, "sent again"), "no_of_persons": F.when(i % 3 == 0, i % 5), "core_total": F.col("total") - F.col("tax_total"), "tax_total": F.col("tax_total"),
        "discount_total": F.when(i % 4 == 0, 10.0), "delivery_charges": F.when(i % 3 == 1, "30.50"), "round_off": F.when(i % 2 == 0, F.lit("-0.25")),
    }
    order = F.struct(i.alias("orderID"), made.alias("created_on"), "total", "order_from", F.col("order_status").alias("status"), *[v.alias(k) for k, v in header.items()])
    inner = F.struct(
        order.alias("Order"), F.struct("name", phone.alias("phone"), address.alias("address")).alias("Customer"), F.struct(F.lit("r1").alias("restID"), F.lit("Main street").alias("res_name")).alias("Restaurant"),
        F.coalesce(item, F.array()).alias("OrderItem"), F.array(tax("CGST"), tax("SGST")).alias("Tax"), discount.alias("Discount"),
    )
    stream_id = (F.col("order_id") * 2 + F.col("again") * 1_000_000_001).alias("stream_id")
    event = F.struct(stream_id, F.concat_ws("-", "order_id", "again").alias("event_id"), F.concat(F.lit("order-"), i.cast("string")).alias("aggregate_id"), made.alias("occurred_at"), F.struct(F.struct(inner.alias("properties")).alias("raw_payload")).alias("raw_event"))
    return events.select(stream_id, F.to_json(event).alias("payload"))


def opened(feed: DataFrame, brief: bool = False) -> DataFrame:
    """One row for each order of ``feed(payload)``, from its latest event; broken documents are left out.
    ``brief``: only what counters of customers need is read and moved."""
    kept = _BRIEF if brief else _PROPERTIES
    e = feed.select(F.from_json("payload", f"struct<{_event(kept)}>").alias("e")).filter("e.stream_id is not null")
    p = "e.raw_event.raw_payload.properties"
    rows = e.select("e.stream_id", "e.event_id", F.coalesce(parsed_time(F.col(f"{p}.Order.created_on")), parsed_time(F.col("e.occurred_at"))).alias("created_on"), *[F.col(f"{p}.{c}") for c in kept])
    return latest(rows.withColumn("order_id", F.col("Order.orderID")), ["order_id"], "stream_id")


def headers(feed: DataFrame) -> DataFrame:
    """The whole header of each order of ``feed(payload)``: its fields as its first event has them, since a later
    one brings its stream_id and event_id only. Amounts and persons that are missing or no numbers are 0,
    a missing type, origin or status is empty; broken documents and those without an order id are left out."""
    e = feed.select(F.from_json("payload", f"struct<{_event({k: _PROPERTIES[k] for k in ('Order', 'Restaurant')})}>").alias("e")).filter("e.stream_id is not null and e.raw_event.raw_payload.properties.Order.orderID is not null")
    p = "e.raw_event.raw_payload.properties"
    o = lambda c: F.col(f"{p}.Order.{c}")
    occurred = parsed_time(F.col("e.occurred_at"))
    first = F.struct(
        F.col("e.aggregate_id").alias("aggregate_id"), F.col(f"{p}.Restaurant.restID").alias("restaurant"), occurred.alias("occurred_at"), F.coalesce(parsed_time(o("created_on")), occurred).alias("created_on"),
        *[F.coalesce(o(c), F.lit("")).alias(name) for c, name in (("order_type", "order_type"), ("order_from", "order_from"), ("status", "order_status"))], *[o(c).alias(c) for c in _TEXTS if c != "order_type"],
        F.coalesce(o("no_of_persons").try_cast("int"), F.lit(0)).alias("no_of_persons"), *[F.coalesce(o(c).try_cast("double"), F.lit(0.0)).alias(c) for c in _AMOUNTS], F.coalesce(o("total"), F.lit(0.0)).alias("total"),
    )
    rows = e.select(o("orderID").alias("order_id"), F.col("e.stream_id").alias("stream_id"), F.col("e.event_id").alias("event_id"), first.alias("first"))
    each = rows.groupBy("order_id").agg(F.max("stream_id").alias("stream_id"), F.max_by("event_id", "stream_id").alias("event_id"), F.min_by("first", "stream_id").alias("first"))
    return each.select("order_id", "stream_id", "event_id", "first.*")


def key_of(rows: DataFrame) -> Column:
    c = rows["Customer"]
    return identity_key(c["phone"], c["name"], c["address"], rows["event_id"])


def tables(feed: DataFrame) -> dict[str, DataFrame]:
    """orders, items, addons, taxes, discounts and restaurants of a feed."""
    rows = opened(feed)
    rows = rows.withColumn("identity_key", key_of(rows))
    line = lambda x: [F.col(f"{x}.itemid").alias("menu_item_id"), F.col(f"{x}.quantity").alias("quantity"), F.col(f"{x}.price").alias("unit_price"), F.col(f"{x}.total").alias("total_price")]
    items = rows.select("order_id", F.posexplode("OrderItem").alias("position", "x"))
    return {
        "orders": rows.select("order_id", "stream_id", "identity_key", "created_on", F.col("Order.total").alias("total"), F.col("Order.order_from").alias("order_from"), F.col("Order.status").alias("order_status"), F.col("Restaurant.restID").alias("restaurant")),
        "items": items.select("order_id", "position", *line("x")),
        "addons": items.select("order_id", "position", F.posexplode("x.addon").alias("addon", "y")).select("order_id", "position", "addon", *line("y")),
        "taxes": rows.select("order_id", F.inline("Tax")),
        "discounts": rows.select("order_id", F.inline("Discount")),
        "restaurants": rows.select(F.col("Restaurant.restID").alias("restaurant"), F.col("Restaurant.res_name").alias("name")).distinct(),
    }


def customers_of(feed: DataFrame) -> DataFrame:
    """Customers by identity key: first name, phone and address by stream, counters, and whether
    verified; what was once known or verified stays so."""
    rows = opened(feed, brief=True)
    known = rows.select(key_of(rows).alias("identity_key"), "stream_id", "created_on", F.col("Order.total").alias("total"), F.col("Customer.name").alias("name"), F.col("Customer.phone").alias("phone"), F.trim("Customer.address").alias("address"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("stream_id"))).alias(c)
    out = known.groupBy("identity_key").agg(first("name"), first("phone"), first("address"), F.min("created_on").alias("first_order"), F.max("created_on").alias("last_order"), F.count(F.lit(1)).alias("total_orders"), F.sum("total").alias("total_spent"))
    return out.withColumn("is_verified", ~F.col("identity_key").startswith("anon:"))


def address_book(feed: DataFrame) -> DataFrame:
    """Each customer's different addresses (case and spaces aside); the first by stream is the default."""
    rows = opened(feed, brief=True)
    seen = rows.select(key_of(rows).alias("identity_key"), "stream_id", F.trim("Customer.address").alias("address")).filter("address <> ''")
    each = seen.groupBy("identity_key", normal_text(F.col("address")).alias("folded")).agg(F.min_by("address", "stream_id").alias("address"), F.min("stream_id").alias("since"))
    place = F.row_number().over(Window.partitionBy("identity_key").orderBy("since"))
    return each.select("identity_key", "address", (place == 1).alias("is_default"))


def running_counters(feed: DataFrame) -> DataFrame:
    """Every order with its customer's orders and spend up to it, in the order of the stream."""
    rows = opened(feed, brief=True)
    upto = Window.partitionBy("identity_key").orderBy("stream_id").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.select("order_id", "stream_id", key_of(rows).alias("identity_key"), F.col("Order.total").alias("total"))
    return known.select("order_id", "identity_key", F.count(F.lit(1)).over(upto).alias("orders_so_far"), F.round(F.sum("total").over(upto), 2).alias("spent_so_far"))

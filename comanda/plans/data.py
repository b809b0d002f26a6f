"""Registered queries on sources, sinks, scalars, ingestion and changing tables, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from comanda.functions import scalars
from comanda.functions.dates import text_date
from comanda.operators import insights
from comanda.plans.base import NOW, TODAY, add, inside
from comanda.session import scratch, written
from comanda.sources import files, payloads
from comanda.sources.adapter import Shop
from comanda.streaming import customers, incremental, tables, versions

# scalars -----------------------------------------------------------------------------------------


def _times(s: Shop):
    t = F.date_format("created_on", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("order_id") % 6
    text = F.when(k == 0, F.date_format("created_on", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.concat(t, F.lit(".250+0000"))).when(k == 2, F.concat(t, F.lit("+05:30"))).when(k == 3, F.concat(t, F.lit(".5"))).when(k == 4, t).otherwise(F.lit("no time"))
    return s.orders.select("order_id", F.date_format(scalars.parsed_time(text), "yyyy-MM-dd HH:mm:ss.SSS").alias("local"))


add("X7_parsed_times", _times, "SELECT order_id, strftime(CASE order_id % 6 WHEN 1 THEN created_on + INTERVAL 330 MINUTE + INTERVAL 250 MILLISECOND WHEN 3 THEN created_on + INTERVAL 500 MILLISECOND WHEN 5 THEN NULL ELSE created_on END, '%Y-%m-%d %H:%M:%S.%g') AS local FROM o")
add("X6_business_dates", lambda s: s.orders.select("order_id", text_date(scalars.current_business_date(F.col("created_on"))).alias("open_day"), text_date(scalars.last_complete_business_date(F.col("created_on"))).alias("complete_day")), "SELECT order_id, CAST(CAST(created_on + INTERVAL 30 MINUTE AS DATE) AS VARCHAR) AS open_day, CAST(CAST(created_on + INTERVAL 30 MINUTE AS DATE) - 1 AS VARCHAR) AS complete_day FROM o")
_HOLIDAYS = ", ".join(f"(DATE '{d}', '{n}')" for d, n in scalars.HOLIDAYS)
add(
    "X8_holiday_sales", lambda s: s.success.withColumn("day", F.to_date(F.add_months("business_date", 336))).join(F.broadcast(scalars.holidays(s.spark)), "day").groupBy(text_date(F.col("day")).alias("day"), "holiday").agg(F.count(F.lit(1)).alias("num_orders"), F.round(F.sum("total"), 2).alias("revenue")),
    f", h(day, holiday) AS (VALUES {_HOLIDAYS}) SELECT CAST(h.day AS VARCHAR) AS day, holiday, count(*) AS num_orders, round(sum(total), 2) AS revenue FROM ok JOIN h ON h.day = CAST(bd + INTERVAL 336 MONTH AS DATE) GROUP BY 1, 2",
)
_LABEL = "CASE WHEN x >= 10000000 THEN '₹' || CAST(round(x / 10000000, 1) AS VARCHAR) || 'Cr' WHEN x >= 100000 THEN '₹' || CAST(round(x / 100000, 1) AS VARCHAR) || 'L' WHEN x >= 1000 THEN '₹' || CAST(round(x / 1000, 1) AS VARCHAR) || 'K' ELSE '₹' || CAST(x AS VARCHAR) END"
add(
    "X17_money_labels", lambda s: s.orders.select("order_id", (F.col("total") * F.element_at(F.array(*map(F.lit, (0.01, 1.0, 1000.0))), (F.col("order_id") % 3 + 1).cast("int"))).alias("x")).select("order_id", scalars.indian_grouping(F.col("x")).alias("grouped"), scalars.chart_label(scalars.rounded(F.col("x"), 2)).alias("label")),
    f", z AS (SELECT order_id, total * [0.01::DOUBLE, 1.0, 1000.0][CAST(order_id % 3 + 1 AS INTEGER)] AS y FROM o), v AS (SELECT order_id, CAST(trunc(y) AS BIGINT)::VARCHAR AS t, round(y, 2) AS x FROM z) SELECT order_id, CASE WHEN length(t) <= 3 THEN t ELSE ltrim(reverse(regexp_replace(reverse(t[:-4]), '(..)', '\\1,', 'g')), ',') || ',' || t[-3:] END AS grouped, {_LABEL} AS label FROM v",
)
add("X17_hour_labels", lambda s: s.success.groupBy(F.hour("created_on").alias("hour")).agg(F.count(F.lit(1)).alias("n")).select(scalars.hour_label(F.col("hour")).alias("hour"), "n"), "SELECT strftime(make_timestamp(2000, 1, 1, hour(created_on), 0, 0), '%-I %p') AS hour, count(*) AS n FROM ok GROUP BY 1")
add("X17_headers", lambda s: s.raw("events").select(F.explode(F.array(F.concat("event_type", F.lit("_id")), F.concat(F.lit("url_of_"), "event_type"))).alias("k")).distinct().select("k", scalars.header_label(F.col("k")).alias("header")), "SELECT DISTINCT k, CASE WHEN k LIKE '%\\_id' ESCAPE '\\' THEN upper(k[1]) || k[2:-4] || ' ID' ELSE 'URL Of ' || upper(k[8]) || k[9:] END AS header FROM (SELECT unnest([event_type || '_id', 'url_of_' || event_type]) AS k FROM events)")
add("X20_rain", lambda s: s.weather.select(text_date(F.col("day")).alias("day"), scalars.rain_category(F.col("rain_sum") - 2).alias("rain")), "SELECT CAST(day AS VARCHAR) AS day, CASE WHEN rain_sum - 2 >= 2.5 THEN 'heavy' WHEN rain_sum - 2 >= 0.6 THEN 'drizzle' ELSE 'none' END AS rain FROM w")


def _numeric(s: Shop):
    year, week = scalars.cyclic(F.dayofyear("business_date"), 365), scalars.cyclic(F.weekday("business_date"), 7)
    mean, spread = scalars.lognormal_moments(F.log1p("total") / 4, F.lit(0.5))
    cols = {"year_sin": year[0], "year_cos": year[1], "week_sin": week[0], "week_cos": week[1], "log_total": F.log1p("total"), "back": F.expm1(F.log1p("total")), "mean": mean, "spread": spread, "close": scalars.closeness(F.col("total"), F.col("order_id"))}
    return s.orders.select("order_id", *[F.round(c, 5).alias(k) for k, c in cols.items()])


add(
    "X21_numeric", _numeric,
    """SELECT order_id, round(sin(2 * pi() * dayofyear(bd) / 365), 5) AS year_sin, round(cos(2 * pi() * dayofyear(bd) / 365), 5) AS year_cos, round(sin(2 * pi() * (isodow(bd) - 1) / 7), 5) AS week_sin, round(cos(2 * pi() * (isodow(bd) - 1) / 7), 5) AS week_cos, round(ln(1 + total), 5) AS log_total, round(total, 5) AS back,
round(exp(ln(1 + total) / 4 + 0.125::DOUBLE) - 1, 5) AS mean, round(sqrt((exp(0.25::DOUBLE) - 1) * exp(2 * ln(1 + total) / 4 + 0.25::DOUBLE)), 5) AS spread, round(greatest(0.0, 1 - abs(total - order_id) / greatest(abs(total), abs(order_id), 1.0)), 5) AS close FROM o""",
)
add("X24_numbers", lambda s: s.customers.select("customer_id", scalars.number_of(F.element_at(F.array(F.lit("12.5"), F.lit("abc"), F.lit("NaN"), F.lit("Infinity"), F.col("customer_id").cast("string"), F.lit(None).cast("string")), (F.col("customer_id") % 6 + 1).cast("int"))).alias("x")), "SELECT customer_id, CASE customer_id % 6 WHEN 0 THEN 12.5 WHEN 4 THEN CAST(customer_id AS DOUBLE) END AS x FROM c")
add("F14_weekend_days", lambda s: s.orders.withColumn("day", F.to_date("created_on")).filter(scalars.named_weekday(F.col("day"), ["Saturday", "Sunday"])).groupBy(text_date(F.col("day")).alias("day")).agg(F.count(F.lit(1)).alias("orders")), "SELECT CAST(CAST(created_on AS DATE) AS VARCHAR) AS day, count(*) AS orders FROM o WHERE dayname(created_on) IN ('Saturday', 'Sunday') GROUP BY 1")
add("F16_null_safe_match", lambda s: s.menu.select("menu_item_id", F.nullif("unit", F.lit("mg")).alias("u")).alias("a").join(F.broadcast(s.spark.createDataFrame([("g", "gram"), (None, "none")], "v string, label string")), F.col("a.u").eqNullSafe(F.col("v"))).select("menu_item_id", "label"), "SELECT menu_item_id, label FROM m JOIN (VALUES ('g', 'gram'), (NULL, 'none')) t(v, label) ON nullif(unit, 'mg') IS NOT DISTINCT FROM v")
add("F18_empty_result", lambda s: scalars.is_effectively_empty(s.customers.join(s.orders, "customer_id", "left_anti").select(F.nullif(F.trim("name"), F.lit("")).alias("a"), F.nullif(F.trim("segment"), F.lit("")).alias("b"))), "SELECT NOT coalesce(bool_or(nullif(trim(name), '') IS NOT NULL OR nullif(trim(segment), '') IS NOT NULL), false) AS is_empty FROM c WHERE customer_id NOT IN (SELECT customer_id FROM o)")

# files -------------------------------------------------------------------------------------------


def _csv(s: Shop):
    path = scratch(s.spark, "csv")
    rows = s.menu.select("menu_item_id", F.when(F.col("menu_item_id") % 5 == 0, F.lit(None)).when(F.col("menu_item_id") % 5 == 1, F.lit("")).otherwise(F.concat(F.lit('say "'), "name", F.lit('", or\nnot'))).alias("name"), "price")
    files.write_csv(rows, path)
    return files.read_csv(s.spark, path, rows.schema)


add("S5_csv_round_trip", _csv, "SELECT menu_item_id, CASE menu_item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'say \"' || name || '\", or' || chr(10) || 'not' END AS name, price FROM m")


def _json_array(s: Shop):
    path = scratch(s.spark, "json")
    s.raw("nation").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).coalesce(1).write.text(path)  # 25 rows
    return files.read_json_array(s.spark, path, "n_nationkey bigint, n_name string")


add("S3_json_array", _json_array, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")


def _json_lines(s: Shop):
    path = scratch(s.spark, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    s.raw("events").select(F.when(F.col("event_id") % 10 == 3, F.lit('{"event_id": 1, "ev')).otherwise(line).alias("value")).write.text(path)
    return files.read_json_lines(s.spark, path, "event_id bigint, event_type string, value double")


add("S8_json_lines", _json_lines, "SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 3")
_MAPPING = lambda s: s.menu.select(F.concat_ws(":", (F.col("menu_item_id") % 50).cast("string"), "type").alias("target"), F.col("menu_item_id").cast("string").alias("source"), F.col("name").alias("raw"), F.col("unit").alias("variant"))
add("S7_backup_round_trip", lambda s: files.from_backup(files.to_backup(_MAPPING(s))), "SELECT (menu_item_id % 50) || ':' || type AS target, CAST(menu_item_id AS VARCHAR) AS source, name AS raw, unit AS variant FROM m")
add("S9_weather_arrays", lambda s: files.weather_rows(files.weather_document(s.weather)).select(text_date(F.col("day")).alias("day"), "temp_max", "rain_sum"), "SELECT CAST(day AS VARCHAR) AS day, temp_max, rain_sum FROM w")
add("X23_temperature_map", lambda s: files.temperature_on(files.weather_document(s.weather), insights.calendar(s, *NOW)).select(text_date(F.col("day")).alias("day"), "temp_max"), f"SELECT CAST(d AS VARCHAR) AS day, temp_max FROM (SELECT CAST(unnest(generate_series(DATE '{NOW[0]}', DATE '{NOW[1]}', INTERVAL 1 DAY)) AS DATE) AS d) x LEFT JOIN w ON w.day = x.d")

# ingestion ---------------------------------------------------------------------------------------

_EV = """, ev AS (SELECT o.*, order_id * 2 + CASE WHEN order_id % 5 = 0 THEN 1000000001 ELSE 0 END AS stream_id, total + CASE WHEN order_id % 5 = 0 THEN 1 ELSE 0 END AS t, name, CASE WHEN customer_id % 3 = 0 THEN '98' || lpad(CAST(customer_id - customer_id % 2 AS VARCHAR), 8, '0') END AS digits,
CASE WHEN customer_id % 3 <> 2 THEN CASE WHEN order_id % 2 = 0 THEN 'STREET  ' ELSE 'Street  ' END || order_id % 3 END AS address, CASE customer_id % 3 WHEN 0 THEN 'phone:' || sha256('98' || lpad(CAST(customer_id - customer_id % 2 AS VARCHAR), 8, '0')) WHEN 1 THEN 'addr:' || sha256(lower(name) || '|street ' || order_id % 3) ELSE 'anon:' || sha256(order_id || '-' || CASE WHEN order_id % 5 = 0 THEN 1 ELSE 0 END) END AS identity_key FROM o JOIN c USING (customer_id)),
it AS (SELECT i.*, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line_no, menu_item_id, quantity, unit_price, total_price) - 1 AS INTEGER) AS position FROM i),
ad AS (SELECT a.*, CAST(row_number() OVER (PARTITION BY order_id ORDER BY line_no, menu_item_id, quantity, unit_price, total_price) - 1 AS INTEGER) AS addon FROM a WHERE order_id IN (SELECT order_id FROM i))"""


def _feed(s: Shop):
    return payloads.tables(payloads.order_feed(s))


add("S4_orders", lambda s: _feed(s)["orders"].withColumn("created_on", F.col("created_on").cast("string")), _EV + " SELECT order_id, stream_id, identity_key, strftime(created_on, '%Y-%m-%d %H:%M:%S') AS created_on, t AS total, order_from, order_status, 'r1' AS restaurant FROM ev")
add(
    "S4_headers", lambda s: payloads.headers(payloads.order_feed(s)).withColumn("occurred_at", F.col("occurred_at").cast("string")).withColumn("created_on", F.col("created_on").cast("string")),
    _EV + """ SELECT order_id, stream_id, order_id || '-' || CASE WHEN order_id % 5 = 0 THEN 1 ELSE 0 END AS event_id, 'order-' || order_id AS aggregate_id, 'r1' AS restaurant, strftime(created_on, '%Y-%m-%d %H:%M:%S') AS occurred_at, strftime(created_on, '%Y-%m-%d %H:%M:%S') AS created_on,
['Dine In', 'Delivery', 'Pick Up'][CAST(order_id % 3 + 1 AS INTEGER)] AS order_type, order_from, order_status, CASE WHEN order_id % 3 = 0 THEN 'AC' END AS sub_order_type, CAST(order_id AS VARCHAR) AS order_from_id, 'biller ' || order_id % 7 AS biller, CAST(NULL AS VARCHAR) AS assignee,
CASE WHEN order_id % 3 = 0 THEN CAST(order_id % 20 AS VARCHAR) END AS table_no, CAST(order_id % 100 AS VARCHAR) AS token_no, customer_id || '-' || order_id AS customer_invoice_id, CAST(NULL AS VARCHAR) AS comment, CAST(CASE WHEN order_id % 3 = 0 THEN order_id % 5 ELSE 0 END AS INTEGER) AS no_of_persons,
total - tax_total AS core_total, tax_total, CASE WHEN order_id % 4 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS discount_total, CASE WHEN order_id % 3 = 1 THEN 30.5::DOUBLE ELSE 0.0::DOUBLE END AS delivery_charges, 0.0::DOUBLE AS packaging_charge, 0.0::DOUBLE AS service_charge,
CASE WHEN order_id % 2 = 0 THEN -0.25::DOUBLE ELSE 0.0::DOUBLE END AS round_off, total FROM ev""",
)
add("S4_items", lambda s: _feed(s)["items"], _EV + " SELECT order_id, position, menu_item_id, quantity, unit_price, total_price FROM it WHERE order_id IN (SELECT order_id FROM o)")
add("S4_addons", lambda s: _feed(s)["addons"], _EV + " SELECT order_id, CAST(0 AS INTEGER) AS position, addon, menu_item_id, quantity, unit_price, total_price FROM ad WHERE order_id IN (SELECT order_id FROM o)")
add("S4_taxes", lambda s: _feed(s)["taxes"], _EV + " SELECT order_id, title, 2.5::DOUBLE AS rate, t * 0.025::DOUBLE AS amount FROM ev, (SELECT unnest(['CGST', 'SGST']) AS title)")
add("S4_discounts", lambda s: _feed(s)["discounts"], _EV + " SELECT order_id, 'Welcome' AS title, 10.0::DOUBLE AS amount FROM ev WHERE order_id % 4 = 0")
add("S4_restaurants", lambda s: _feed(s)["restaurants"], "SELECT 'r1' AS restaurant, 'Main street' AS name")
add(
    "E1_customer_upsert", lambda s: payloads.customers_of(payloads.order_feed(s)).select("identity_key", "name", "phone", "address", F.col("first_order").cast("string").alias("first_order"), F.col("last_order").cast("string").alias("last_order"), "total_orders", F.round("total_spent", 2).alias("total_spent"), "is_verified"),
    _EV + " SELECT identity_key, arg_min(name, stream_id) AS name, '+91 ' || min(digits) AS phone, arg_min(address, stream_id) AS address, strftime(min(created_on), '%Y-%m-%d %H:%M:%S') AS first_order, strftime(max(created_on), '%Y-%m-%d %H:%M:%S') AS last_order, count(*) AS total_orders, round(sum(t), 2) AS total_spent, NOT starts_with(identity_key, 'anon') AS is_verified FROM ev GROUP BY 1",
)
add(
    "E2_address_book", lambda s: payloads.address_book(payloads.order_feed(s)),
    _EV + ", b AS (SELECT identity_key, lower(address) AS f, arg_min(address, stream_id) AS address, min(stream_id) AS since FROM ev WHERE address IS NOT NULL GROUP BY 1, 2) SELECT identity_key, address, since = min(since) OVER (PARTITION BY identity_key) AS is_default FROM b",
)
add("T3_running_counters", lambda s: payloads.running_counters(payloads.order_feed(s)), _EV + " SELECT order_id, identity_key, count(*) OVER x AS orders_so_far, round(sum(t) OVER x, 2) AS spent_so_far FROM ev WINDOW x AS (PARTITION BY identity_key ORDER BY stream_id)")


def _replayed(s: Shop):
    feed = payloads.order_feed(s)
    rows = payloads.tables(feed.unionByName(feed.filter("stream_id % 7 = 0")))["items"]
    return rows.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("total_price"), 2).alias("amount"))


add("T2_replay_is_idempotent", _replayed, "SELECT order_id, count(*) AS lines, round(sum(total_price), 2) AS amount FROM i WHERE order_id IN (SELECT order_id FROM o) GROUP BY 1")

def _kept_customers(s: Shop):
    """Half of the orders, some walk-in customers verified by hand, the other half, and then all events again
    with the later ones of some orders."""
    feed = written(payloads.order_feed(s), "feed", "zstd")
    book = customers.Customers.open(s.spark, scratch(s.spark, "customers"), buckets=16)
    half = lambda k: feed.filter((F.col("stream_id") < 1_000_000_000) & (F.floor(F.col("stream_id") / 2) % 2 == k))
    book.ingest(half(0), 0)
    known = payloads.opened(half(0), brief=True).filter("order_id % 4 = 0")
    book.verify(known.select(payloads.key_of(known).alias("identity_key")).filter("startswith(identity_key, 'anon:')"))
    book.ingest(half(1), 1)
    book.ingest(feed, 2)
    rows = book.customers.read()
    return rows.withColumn("first_order", F.col("first_order").cast("string")).withColumn("last_order", F.col("last_order").cast("string")).withColumn("total_spent", F.round("total_spent", 2))


add(
    "E1_kept_customers", _kept_customers,
    _EV + """, ar AS (SELECT *, (order_id % 2) * 1000000000000 + order_id AS place FROM ev) SELECT identity_key, arg_min(name, place) AS name, '+91 ' || min(digits) AS phone, arg_min(address, place) AS address, strftime(min(created_on), '%Y-%m-%d %H:%M:%S') AS first_order, strftime(max(created_on), '%Y-%m-%d %H:%M:%S') AS last_order, count(*) AS total_orders, round(sum(t), 2) AS total_spent,
NOT starts_with(identity_key, 'anon') OR bool_or(order_id % 4 = 0 AND order_id % 5 <> 0) AS is_verified FROM ar GROUP BY 1
UNION ALL SELECT 'anon:' || sha256(order_id || '-0'), name, NULL, NULL, strftime(created_on, '%Y-%m-%d %H:%M:%S'), strftime(created_on, '%Y-%m-%d %H:%M:%S'), 0, 0.0::DOUBLE, true FROM ev WHERE customer_id % 3 = 2 AND order_id % 20 = 0""",
)


def _versioned_events(s: Shop):
    """Each user's last event, from a table that took the events in by thirds, the last third first."""
    rows = s.raw("events").select("user_id", "event_id", "event_type", F.round("value", 2).alias("value"))
    table = versions.Table.create(s.spark, scratch(s.spark, "events"), "user_id bigint, event_id bigint, event_type string, value double", ["user_id"], buckets=16)
    for k in (2, 1, 0):
        table.upsert(rows.filter(F.col("event_id") % 3 == k), "event_id", 2 - k)
    return table.read()


add("S10_versioned_upsert", _versioned_events, "SELECT user_id, event_id, event_type, round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")

# changing tables ---------------------------------------------------------------------------------

_OLD = lambda s: s.menu.filter("menu_item_id % 3 <> 0").select("menu_item_id", "name", "price")
_NEW = lambda s: s.menu.filter("menu_item_id % 2 = 0").select("menu_item_id", F.when(F.col("menu_item_id") % 4 == 0, F.lit(None)).otherwise(F.lit("new")).alias("name"), (F.col("price") + 1).alias("price"))
add("S10_upsert", lambda s: tables.upserted(_OLD(s), _NEW(s), ["menu_item_id"], keep=["name"]), "SELECT menu_item_id, CASE WHEN menu_item_id % 3 <> 0 THEN name WHEN menu_item_id % 4 = 0 THEN NULL ELSE 'new' END AS name, price + CASE WHEN menu_item_id % 2 = 0 THEN 1 ELSE 0 END AS price FROM m WHERE menu_item_id % 3 <> 0 OR menu_item_id % 2 = 0")
add("S11_replace", lambda s: tables.replaced(_OLD(s), _NEW(s).drop("name"), ["menu_item_id"]), "SELECT menu_item_id, CASE WHEN menu_item_id % 2 <> 0 THEN name END AS name, price + CASE WHEN menu_item_id % 2 = 0 THEN 1 ELSE 0 END AS price FROM m WHERE menu_item_id % 3 <> 0 OR menu_item_id % 2 = 0")
add("S12_insert_or_ignore", lambda s: tables.inserted(_OLD(s), _NEW(s).unionByName(_NEW(s)), ["menu_item_id"]), "SELECT menu_item_id, CASE WHEN menu_item_id % 3 <> 0 THEN name WHEN menu_item_id % 4 = 0 THEN NULL ELSE 'new' END AS name, price + CASE WHEN menu_item_id % 3 = 0 THEN 1 ELSE 0 END AS price FROM m WHERE menu_item_id % 3 <> 0 OR menu_item_id % 2 = 0")
_EVENTS = lambda s: s.raw("events").select("event_id", "user_id", "event_type", F.when(F.col("user_id") % 2 == 0, "local").otherwise("cloud").alias("origin"))
add("S13_next_batch", lambda s: tables.next_batch(_EVENTS(s), s.raw("events").filter("event_id % 3 = 0").select("event_id"), ["event_id"], "event_id", 500, "local"), "SELECT event_id, user_id, event_type, 'local' AS origin FROM events WHERE user_id % 2 = 0 AND event_id % 3 <> 0 ORDER BY event_id LIMIT 500")


def _bootstrapped(s: Shop):
    own = s.menu.filter("menu_item_id % 3 = 0").select("menu_item_id", "price", F.lit("local").alias("origin"))
    pulled = s.menu.filter("menu_item_id % 2 = 0").select("menu_item_id", (F.col("price") * 2).alias("price"), F.lit("bootstrap").alias("origin"))
    return tables.upserted(own, pulled, ["menu_item_id"])


add("S14_bootstrap_pull", _bootstrapped, "SELECT menu_item_id, price * CASE WHEN menu_item_id % 2 = 0 THEN 2 ELSE 1 END AS price, CASE WHEN menu_item_id % 2 = 0 THEN 'bootstrap' ELSE 'local' END AS origin FROM m WHERE menu_item_id % 3 = 0 OR menu_item_id % 2 = 0")
add("S14_not_shipped_again", lambda s: tables.next_batch(_bootstrapped(s), s.menu.select("menu_item_id").limit(0), ["menu_item_id"], "menu_item_id", 1000, "local"), "SELECT menu_item_id, price, 'local' AS origin FROM m WHERE menu_item_id % 3 = 0 AND menu_item_id % 2 <> 0 ORDER BY menu_item_id LIMIT 1000")
add(
    "T5_new_events", lambda s: tables.new_events(s.raw("events").select(F.floor(F.col("event_id") / 2).alias("remote_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("local_id")), s.raw("events").select(F.col("event_id").alias("remote_id")).filter("remote_id % 7 = 0"), s.raw("events").select(F.col("user_id").alias("local_id")).filter("local_id % 5 = 0").distinct()),
    "SELECT remote_id, seq, local_id FROM (SELECT event_id // 2 AS remote_id, min(event_id) AS seq, arg_min(user_id, event_id) AS local_id FROM events GROUP BY 1) WHERE remote_id % 7 <> 0 AND local_id % 5 <> 0",
)
add("T6_replay_page", lambda s: tables.replay_page(s.raw("events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 97 != 40).alias("ok")), 100, 50), "SELECT event_id AS seq, event_id % 97 <> 40 AS ok, event_id < 137 AS applies, CAST(100 AS BIGINT) AS next_cursor FROM events WHERE event_id BETWEEN 101 AND 150")
add("T8_events_to_emit", lambda s: tables.to_emit(_EVENTS(s)), "SELECT event_id, user_id, event_type, 'local' AS origin FROM events WHERE user_id % 2 = 0")
add(
    "T9_missing_events", lambda s: tables.missing_events(s.customers.select(F.col("customer_id").alias("merge_id"), (F.col("customer_id") % 3 == 0).alias("undone")), s.customers.filter("customer_id % 4 <> 1").select(F.col("customer_id").alias("merge_id"), F.lit("merge").alias("event_type"))),
    "SELECT customer_id AS merge_id, 'merge' AS event_type FROM c WHERE customer_id % 4 = 1 UNION ALL SELECT customer_id, 'undo' FROM c WHERE customer_id % 3 = 0",
)
add("T14_signed_events", lambda s: tables.signed(s.raw("events").select("user_id", "event_id", "event_type", F.col("event_id").alias("seq")), ["user_id"], "seq"), """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq, sha256('{"event_id":' || max(event_id) || ',"event_type":"' || arg_max(event_type, event_id) || '","user_id":' || user_id || '}') AS signature FROM events GROUP BY user_id""")
_CONV = lambda s: s.raw("conversations").groupBy("conv_id").agg((F.max("turn") * 10 + F.col("conv_id") % 10).alias("updated_at")).withColumn("synced_at", F.when(F.col("conv_id") % 3 == 1, F.col("updated_at") - 1).when(F.col("conv_id") % 3 == 2, F.col("updated_at")))
add(
    "T10_conversations_to_sync", lambda s: tables.conversations_to_sync(_CONV(s), s.raw("conversations")).select("conv_id", "updated_at", F.size("messages").alias("n_messages"), F.array_join(F.col("messages.role"), ",").alias("roles")),
    "SELECT z.conv_id, z.updated_at, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role, ',' ORDER BY turn, role) AS roles FROM (SELECT conv_id, max(turn) * 10 + conv_id % 10 AS updated_at FROM conversations GROUP BY conv_id HAVING conv_id % 3 < 2 ORDER BY updated_at, conv_id LIMIT 50) z JOIN conversations USING (conv_id) GROUP BY 1, 2",
)
add("A52_conversation_list", lambda s: s.customers.select(F.col("customer_id").alias("conv_id")).join(s.raw("conversations").select("conv_id", "turn"), "conv_id", "left").groupBy("conv_id").agg(F.count("turn").alias("messages")), "SELECT customer_id AS conv_id, count(turn) AS messages FROM c LEFT JOIN conversations ON conv_id = customer_id GROUP BY 1")
add(
    "N9_current_conversations", lambda s: incremental.latest(s.raw("conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn").filter("conv_id % 7 <> 0").select("conv_id", F.concat(F.lit("last said by "), "role").alias("title")),
    "SELECT conv_id, 'last said by ' || arg_max(role, turn) AS title FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1",
)
_LLM = lambda s: s.raw("events").groupBy(F.col("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("value"), F.min("event_id").alias("created"), F.max(F.when(F.col("event_type") != "signup", F.col("event_id"))).alias("used"))
_LLM_SQL = ", k AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value, min(event_id) AS created, max(event_id) FILTER (WHERE event_type <> 'signup') AS used FROM events GROUP BY 1)"
add("L6_evicted_cache", lambda s: tables.evicted(_LLM(s), 30), _LLM_SQL + " SELECT * FROM k ORDER BY coalesce(used, created) DESC, key DESC LIMIT 30")
add("N6_cache_answers", lambda s: tables.cache_get(_LLM(s).withColumn("is_wrong", F.col("key") % 3 == 0), s.customers.select(F.col("customer_id").alias("key"))), _LLM_SQL + " SELECT customer_id AS key, k.value, k.key IS NOT NULL AS hit FROM c LEFT JOIN k ON k.key = customer_id AND k.key % 3 <> 0")
add("N6_cache_after_put", lambda s: tables.cache_put(_LLM(s), s.spark.range(5).select(F.col("id").alias("key"), F.lit("new").alias("value"), F.lit(10**9).cast("long").alias("created"), F.lit(10**9).cast("long").alias("used")), 20), _LLM_SQL + " , n AS (SELECT * FROM k WHERE key >= 5 UNION ALL SELECT range AS key, 'new', 1000000000, 1000000000 FROM range(5)) SELECT * FROM n ORDER BY coalesce(used, created) DESC, key DESC LIMIT 20")
add("N6_diverse_answers", lambda s: tables.diverse(s.raw("events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("created")), 2), ", d AS (SELECT user_id AS key, event_type AS value, max(event_id) AS created FROM events GROUP BY 1, 2) SELECT key, value, created FROM d QUALIFY row_number() OVER (PARTITION BY key ORDER BY created DESC) <= 2")
add(
    "N7_log_rows", lambda s: tables.log_rows(s.raw("conversations").select("conv_id", "turn", F.col("text").alias("payload")), 300),
    "SELECT conv_id, turn, coalesce(length(text) > 300, false) AS is_summary, CASE WHEN length(text) > 300 THEN substr(text, 1, 200) || '... [' || length(text) || ' characters, ' || substr(sha256(text), 1, 16) || ']' ELSE text END AS payload FROM conversations",
)
add(
    "A50_log_counters", lambda s: s.raw("events").filter(F.to_date("ts").between("2024-01-24", "2024-01-30")).groupBy(text_date(F.to_date("ts")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")),
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1, 2",
)
_DATED = "SELECT order_from, count(*) AS n, round(sum(total), 2) AS revenue FROM orders_view WHERE created_on >= CAST(:yesterday_start AS TIMESTAMP_NTZ) AND created_on < CAST(:today_end AS TIMESTAMP_NTZ) AND order_status = 'Success' GROUP BY order_from"
add("N4_dated_query", lambda s: incremental.dated_sql(s, _DATED, TODAY), f"SELECT order_from, count(*) AS n, round(sum(total), 2) AS revenue FROM ok WHERE bd BETWEEN DATE '{TODAY}' - 1 AND DATE '{TODAY}' GROUP BY 1")
add("N5_chart_rows", lambda s: incremental.chart_rows(s, '{"sql": "WITH t AS (SELECT * FROM menu_view) SELECT type, avg(price) AS p, count(*) AS n FROM t GROUP BY type", "x": "type", "y": "n"}'), "SELECT type AS x, CAST(count(*) AS DOUBLE) AS y FROM m GROUP BY 1")
add("N8_semantic_views", lambda s: incremental.read_only_sql(s, "SELECT type, sum(quantity) AS q FROM (SELECT * FROM items_view UNION ALL SELECT * FROM addons_view) x JOIN menu_view USING (menu_item_id) JOIN orders_view USING (order_id) WHERE order_status = 'Success' GROUP BY type ORDER BY q", 3), f"SELECT type, sum(quantity) AS q FROM sold JOIN m USING (menu_item_id) JOIN ok USING (order_id) WHERE {inside(('1900-01-01', '2100-01-01'))} GROUP BY 1 ORDER BY q LIMIT 3")
add("T1_start_cursor", lambda s: incremental.start_cursor(s.raw("events").filter("event_id < 700"), "event_id", s.customers), "SELECT CAST(max(event_id) AS BIGINT) AS cursor FROM events WHERE event_id < 700")
_APPLIED = lambda s: s.customers.select(F.col("customer_id").alias("remote_id"), (F.col("customer_id") % 50).alias("source"), (F.col("customer_id") % 7).alias("target"), F.col("customer_id").alias("seq"))
_UNDOS = lambda s: s.customers.filter("customer_id % 5 = 0").select(F.col("customer_id").alias("undo_id"), F.when(F.col("customer_id") % 2 == 0, F.col("customer_id")).when(F.col("customer_id") % 3 == 0, F.lit(10**12)).alias("reverts_id"), (F.col("customer_id") % 50).alias("source"), (F.col("customer_id") % 7).alias("target"))
add(
    "T7_undone_events", lambda s: tables.undone_events(_UNDOS(s), _APPLIED(s)),
    "SELECT customer_id AS undo_id, CASE WHEN customer_id % 2 = 0 THEN customer_id ELSE (SELECT max(customer_id) FROM c x WHERE x.customer_id % 50 = c.customer_id % 50 AND x.customer_id % 7 = c.customer_id % 7) END AS remote_id, CASE WHEN customer_id % 2 = 0 THEN 'event' ELSE 'entity' END AS way FROM c WHERE customer_id % 5 = 0",
)

"""All registered queries with their oracle SQL; keys begin with the operator's id."""

from __future__ import annotations

from pyspark.sql import functions as F

from comanda.functions.text import normal_phone, normal_text
from comanda.operators import customers, entities, insights, menu, series
from comanda.plans.base import BEFORE, NOW, ORACLE_SQL, QUERIES, TODAY, YEAR, add  # noqa: F401
from comanda.plans.base import days_of as _days
from comanda.plans.base import inside as _IN
from comanda.plans.base import pct as _pct
from comanda.streaming import incremental

_COUNTS = f"cnt AS (SELECT customer_id, count(*) FILTER (WHERE {_IN(NOW)}) AS n, count(*) FILTER (WHERE {_IN(BEFORE)}) AS before, sum(total) FILTER (WHERE {_IN(NOW)}) AS spend, min(name) AS name FROM vo GROUP BY 1)"
_SOURCES = ", ".join(f"round(coalesce(sum(total) FILTER (WHERE order_from = '{s}'), 0.0), 2) AS revenue_{k}" for k, s in enumerate(insights.SOURCES, 1))
_RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_on, order_id) AS r FROM vo)"
_LOYAL = f"""{_RANKED}, loyal AS (SELECT strftime(bd, '%Y-%m') AS month, count(*) AS orders, count(*) FILTER (WHERE r > 1) AS repeat_orders, count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (WHERE r > 1) AS repeat_customers, sum(total) AS rev, sum(total) FILTER (WHERE r > 1) AS rrev FROM rk GROUP BY 1)"""

add("A1_kpis", lambda s: insights.kpis(s, TODAY), f"SELECT count(*) AS total_orders, round(coalesce(sum(total), 0.0), 2) AS total_revenue, round(avg(total), 2) AS avg_order_value, count(*) FILTER (WHERE is_verified) AS verified_orders, count(DISTINCT customer_id) FILTER (WHERE is_verified) AS verified_customers, round(coalesce(sum(total) FILTER (WHERE bd = DATE '{TODAY}'), 0.0), 2) AS today_revenue FROM ok LEFT JOIN c USING (customer_id)")
add("A3_daily_sales", insights.daily_sales, f"SELECT CAST(bd AS VARCHAR) AS order_date, round(sum(total), 2) AS revenue, round(sum(total - tax_total), 4) AS net_revenue, round(sum(tax_total), 4) AS tax, count(*) AS num_orders, {_SOURCES} FROM ok GROUP BY 1")
add("A4_sales_trend", lambda s: insights.daily_sales(s).select("order_date", "revenue", "num_orders"), "SELECT CAST(bd AS VARCHAR) AS order_date, round(sum(total), 2) AS revenue, count(*) AS num_orders FROM ok GROUP BY 1")
add("A5_category_trend", insights.category_trend, "SELECT CAST(bd AS VARCHAR) AS order_date, type AS category, round(sum(total_price), 2) AS revenue, sum(quantity) AS quantity FROM i JOIN ok USING (order_id) JOIN m USING (menu_item_id) GROUP BY 1, 2")
_SOLD_ONCE = "so AS (SELECT menu_item_id, quantity, total_price FROM i WHERE order_id IN (SELECT order_id FROM ok) UNION ALL SELECT menu_item_id, quantity, total_price FROM (SELECT DISTINCT order_id, menu_item_id, quantity, unit_price, total_price FROM a) d WHERE order_id IN (SELECT order_id FROM ok))"
add("A6_top_items", insights.top_items, f", {_SOLD_ONCE} SELECT menu_item_id, name, coalesce(q, 0.0) AS total_sold, round(r, 2) AS item_revenue, round(100.0 * r / (SELECT sum(total_price) FROM so), 4) AS revenue_share FROM m LEFT JOIN (SELECT menu_item_id, sum(quantity) AS q, sum(total_price) AS r FROM so GROUP BY 1) s USING (menu_item_id) WHERE is_active ORDER BY total_sold DESC, menu_item_id LIMIT 10")
add("X26_category_shares", insights.category_shares, "SELECT type AS category, round(sum(total_price), 2) AS revenue, round(100.0 * sum(total_price) / (SELECT sum(total_price) FROM sold JOIN ok USING (order_id)), 4) AS share FROM sold JOIN ok USING (order_id) JOIN m USING (menu_item_id) GROUP BY 1")
add("A7_revenue_by_category", insights.revenue_by_category, "SELECT type AS category, round(sum(total_price), 2) AS revenue, sum(quantity) AS quantity FROM (SELECT * FROM i UNION ALL SELECT * FROM a) x JOIN m USING (menu_item_id) WHERE order_id IN (SELECT order_id FROM ok) AND type <> '' GROUP BY 1")
_HOURS = "SELECT hour, round(r, 2) AS revenue, num_orders, round(r / nullif(days, 0), 2) AS avg_revenue, CASE WHEN hour >= 5 THEN hour ELSE hour + 24 END AS business_hour FROM (SELECT CAST(hour(created_on) AS INTEGER) AS hour, sum(total) AS r, count(*) AS num_orders FROM sel GROUP BY 1), (SELECT count(DISTINCT bd) AS days FROM sel)"
add("A8_hourly_revenue", insights.hourly_revenue, f", sel AS (SELECT * FROM ok) {_HOURS}")
add("F13_hourly_revenue_weekdays", lambda s: insights.hourly_revenue(s, (0, 6)), f", sel AS (SELECT * FROM ok WHERE dayofweek(bd) IN (0, 6)) {_HOURS}")
add("A9_hourly_revenue_by_date", lambda s: insights.hourly_revenue_of(s, TODAY), f", h AS (SELECT CAST(hour(created_on) AS INTEGER) AS hour, sum(total) AS r, count(*) AS num_orders FROM ok WHERE bd = DATE '{TODAY}' GROUP BY 1), b AS (SELECT *, CASE WHEN hour >= 5 THEN hour ELSE hour + 24 END AS business_hour FROM h) SELECT hour, business_hour, round(r, 2) AS revenue, num_orders, round(sum(r) OVER (ORDER BY business_hour), 2) AS running_revenue FROM b")
add("A10_order_sources", insights.order_sources, "SELECT order_from, count(*) AS num_orders, round(sum(total), 2) AS revenue, round(100.0 * sum(total) / (SELECT sum(total) FROM ok), 2) AS revenue_share FROM ok GROUP BY 1")
add("A11_revenue_by_weekday", lambda s: insights.revenue_by_weekday(s, *YEAR), f", {_days(YEAR)} SELECT CAST(isodow(day) - 1 AS INTEGER) AS weekday, round(avg(revenue), 2) AS avg_revenue, count(*) AS days FROM days GROUP BY 1")
for grain, form in (("day", "CAST(day AS VARCHAR)"), ("week", "strftime(day, '%Y-%W')"), ("month", "strftime(day, '%Y-%m')")):
    add(f"A12_brand_awareness_{grain}", lambda s, g=grain: insights.brand_awareness(s, g), f"SELECT {form} AS bucket, count(*) AS new_customers FROM (SELECT customer_id, CAST(min(created_on) - INTERVAL 5 HOUR AS DATE) AS day FROM vo GROUP BY 1) GROUP BY 1")
add("A13_top_customers", insights.top_customers, ", t AS (SELECT customer_id, name, count(*) AS num_orders, sum(total) AS spend FROM vo GROUP BY 1, 2 ORDER BY spend DESC, customer_id LIMIT 50), q AS (SELECT customer_id, m.name AS item, sum(quantity) AS q FROM sold JOIN vo USING (order_id) JOIN m USING (menu_item_id) GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY q DESC, item) AS r FROM q) SELECT customer_id, name, num_orders, round(spend, 2) AS spend, item AS favourite_item, q AS favourite_quantity FROM t LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (customer_id)")
add("A14_verified_customers", lambda s: s.customers.filter("is_verified").agg(F.count(F.lit(1)).alias("customers")), "SELECT count(*) AS customers FROM c WHERE is_verified")
add("A15_orders_per_customer", lambda s: s.verified_orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("num_orders")), "SELECT customer_id, count(*) AS num_orders FROM vo GROUP BY 1")
add("A16_window_activity", lambda s: customers.window_activity(s, *NOW), f"SELECT customer_id, count(*) AS num_orders, round(sum(total), 2) AS spend, CAST(min(bd) AS VARCHAR) AS first_day, CAST(max(bd) AS VARCHAR) AS last_day, coalesce(min(name), 'Customer ' || customer_id) AS name FROM vo WHERE {_IN(NOW)} GROUP BY 1")
add("A17_return_rate", lambda s: customers.return_rate(s, NOW, BEFORE), f", {_COUNTS} SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2 OR before > 0) AS returning, {_pct('count(*) FILTER (WHERE n >= 2 OR before > 0)', 'count(*)')} AS rate FROM cnt WHERE n > 0")
add("A18_retention_rate", lambda s: customers.retention_rate(s, NOW, BEFORE), f", {_COUNTS} SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 1) AS retained, {_pct('count(*) FILTER (WHERE n >= 1)', 'count(*)')} AS rate FROM cnt WHERE before > 0")
add("A19_repeat_rate", lambda s: customers.repeat_rate(s, NOW), f", {_COUNTS} SELECT count(*) AS customers, count(*) FILTER (WHERE n >= 2) AS repeating, {_pct('count(*) FILTER (WHERE n >= 2)', 'count(*)')} AS rate FROM cnt WHERE n > 0")
add("A20_return_analysis", lambda s: customers.return_analysis(s, NOW, BEFORE), f", {_COUNTS} SELECT customer_id, name, n AS num_orders, before AS lookback_orders, round(coalesce(spend, 0.0), 2) AS spend, n >= 2 OR before > 0 AS is_returning, CASE WHEN n >= 2 AND before > 0 THEN 'both' WHEN n >= 2 THEN 'orders in period' WHEN before > 0 THEN 'earlier order' ELSE 'none' END AS reason FROM cnt WHERE n > 0")
_AFF = f"g AS (SELECT customer_id, count(*) FILTER (WHERE {_IN(NOW)}) AS n, max(bd) FILTER (WHERE bd < DATE '{NOW[0]}') AS last FROM vo GROUP BY 1), aff AS (SELECT customer_id, n AS num_orders, CAST(datediff('day', last, DATE '{NOW[0]}') AS INTEGER) AS gap_days, CASE WHEN last IS NULL OR datediff('day', last, DATE '{NOW[0]}') >= 365 THEN 'New' WHEN datediff('day', last, DATE '{NOW[0]}') <= 60 THEN 'Repeat' ELSE 'Lapsed' END AS segment FROM g WHERE n > 0)"
add("A21_affinity", lambda s: customers.affinity(s, *NOW), f", {_AFF} SELECT * FROM aff")
add("A22_affinity_breakup", lambda s: customers.affinity_breakup(s, *NOW), f", {_AFF} SELECT segment, count(*) AS customers, CAST(sum(num_orders) AS BIGINT) AS num_orders FROM aff GROUP BY 1")
add("A23_monthly_loyalty", customers.monthly_loyalty, f", {_LOYAL} SELECT month, orders, repeat_orders, customers, repeat_customers, round(rev, 2) AS revenue, round(coalesce(rrev, 0.0), 2) AS repeat_revenue, {_pct('repeat_orders', 'orders')} AS order_repeat_rate, {_pct('repeat_customers', 'customers')} AS customer_repeat_rate, {_pct('round(coalesce(rrev, 0.0), 2)', 'round(rev, 2)')} AS revenue_repeat_rate FROM loyal")
add("A24_trailing_reorder", customers.trailing_reorder, f", {_LOYAL}, z AS (SELECT * FROM loyal ORDER BY month DESC LIMIT 3) SELECT round(avg(orders), 2) AS avg_orders, round(avg(repeat_orders), 2) AS avg_repeat_orders, {_pct('sum(repeat_orders)', 'sum(orders)')} AS reorder_rate FROM z")
add("A25_quick_view", lambda s: customers.quick_view(s, NOW, BEFORE), f", {_COUNTS}, z AS (SELECT count(*) AS customers, count(*) FILTER (WHERE n > 0) AS active, count(*) FILTER (WHERE n > 0 AND (n >= 2 OR before > 0)) AS returned, count(*) FILTER (WHERE before > 0 AND n > 0) AS retained, count(*) FILTER (WHERE n >= 2) AS repeating, count(*) FILTER (WHERE before > 0) AS cohort FROM cnt) SELECT customers, active, returned, retained, repeating, {_pct('returned', 'active')} AS return_rate, {_pct('retained', 'cohort')} AS retention_rate, {_pct('repeating', 'active')} AS repeat_rate FROM z")
add("A26_monthly_retention", lambda s: customers.monthly_retention(s, "1998-01-01", 6), f", z AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-06-01', INTERVAL 1 MONTH)) AS DATE) AS start), e AS (SELECT start, customer_id, bool_or(bd >= start) AS now, bool_or(bd < start) AS before FROM z JOIN vo ON bd <= last_day(start) AND bd >= start - 60 GROUP BY 1, 2) SELECT strftime(start, '%Y-%m') AS month, count(*) AS cohort, count(*) FILTER (WHERE now) AS retained, {_pct('count(*) FILTER (WHERE now)', 'count(*)')} AS rate FROM e WHERE before GROUP BY 1")
for grain in ("day", "week", "month"):
    bucket = f"CAST(CAST(date_trunc('{grain}', bd) AS DATE) AS VARCHAR)"
    add(f"A27_reorder_trend_orders_{grain}", lambda s, g=grain: customers.reorder_trend_orders(s, g), f", z AS (SELECT {bucket} AS bucket, EXISTS (SELECT 1 FROM vo p WHERE p.customer_id = vo.customer_id AND p.created_on < vo.created_on) AS again FROM vo) SELECT bucket, count(*) AS orders, count(*) FILTER (WHERE again) AS reorders, {_pct('count(*) FILTER (WHERE again)', 'count(*)')} AS rate FROM z GROUP BY 1")
    add(f"A28_reorder_trend_customers_{grain}", lambda s, g=grain: customers.reorder_trend_customers(s, g), f", z AS (SELECT DISTINCT {bucket} AS bucket, customer_id, CAST(min(bd) OVER (PARTITION BY customer_id) AS VARCHAR) AS first FROM vo) SELECT bucket, count(*) AS customers, count(*) FILTER (WHERE first < bucket) AS returning, {_pct('count(*) FILTER (WHERE first < bucket)', 'count(*)')} AS rate FROM z GROUP BY 1")
_DAY = f"today AS (SELECT * FROM ok WHERE bd = DATE '{TODAY}'), seen AS (SELECT customer_id FROM ok GROUP BY 1 HAVING min(bd) < DATE '{TODAY}')"
add("A29_returning_customers", lambda s: menu.returning_customers(s, TODAY), f", {_DAY} SELECT count(DISTINCT customer_id) AS returning FROM today WHERE customer_id IN (SELECT customer_id FROM seen)")
_AGAIN = f"ag AS (SELECT menu_item_id, count(*) AS customers, count(*) FILTER (WHERE first < DATE '{TODAY}') AS reorder_customers FROM (SELECT customer_id, menu_item_id, min(bd) AS first, bool_or(bd = DATE '{TODAY}') AS now FROM i JOIN vo USING (order_id) GROUP BY 1, 2) WHERE now GROUP BY 1)"
add("A30_item_reorders", lambda s: menu.item_reorders(s, TODAY), f", {_AGAIN} SELECT * FROM ag")
add("A32_today_summary", lambda s: menu.today_summary(s, TODAY), f", {_DAY} SELECT count(*) AS orders, round(coalesce(sum(total), 0.0), 2) AS revenue, count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (WHERE customer_id IN (SELECT customer_id FROM seen)) AS returning, {_SOURCES}, {', '.join(f"count(*) FILTER (WHERE order_from = '{v}') AS orders_{n}" for n, v in enumerate(insights.SOURCES, 1))} FROM today")
add("A33_today_items", lambda s: menu.today_items(s, TODAY), f", {_DAY}, {_AGAIN} SELECT menu_item_id, coalesce(name, 'unknown') AS name, coalesce(type, 'other') AS category, sum(quantity) AS quantity, round(sum(total_price), 2) AS revenue, coalesce(any_value(reorder_customers), 0) AS reorder_customers FROM sold LEFT JOIN m USING (menu_item_id) LEFT JOIN ag USING (menu_item_id) WHERE order_id IN (SELECT order_id FROM today) GROUP BY 1, 2, 3")
add("A34_today_customers", lambda s: menu.today_customers(s, TODAY), f", {_DAY}, n AS (SELECT customer_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS items FROM i JOIN today USING (order_id) JOIN m USING (menu_item_id) GROUP BY 1) SELECT customer_id, round(sum(total), 2) AS order_value, count(*) AS orders, coalesce(any_value(items), '') AS items, customer_id IN (SELECT customer_id FROM seen) AS is_returning, coalesce(any_value(is_verified), false) AS is_verified FROM today LEFT JOIN n USING (customer_id) LEFT JOIN (SELECT customer_id, is_verified FROM c) v USING (customer_id) GROUP BY customer_id")
add("A35_today_orders", lambda s: menu.today_orders(s, TODAY), f", {_DAY}, ln AS (SELECT order_id, customer_id, total, menu_item_id, CAST(sum(quantity) AS BIGINT) AS q FROM i JOIN today USING (order_id) GROUP BY 1, 2, 3, 4), had AS (SELECT DISTINCT customer_id, menu_item_id FROM i JOIN ok USING (order_id) WHERE bd < DATE '{TODAY}') SELECT order_id, customer_id, round(total, 2) AS total, string_agg(name || '(' || q || ')' || CASE WHEN (customer_id, menu_item_id) IN (SELECT (customer_id, menu_item_id) FROM had) THEN '-Repeat' ELSE '' END, ', ' ORDER BY name || '(' || q || ')' || CASE WHEN (customer_id, menu_item_id) IN (SELECT (customer_id, menu_item_id) FROM had) THEN '-Repeat' ELSE '' END) AS items FROM ln JOIN m USING (menu_item_id) GROUP BY 1, 2, 3")
_BR = lambda t, k: f"SELECT menu_item_id, customer_id, bd, quantity, quantity * unit_price AS revenue, row_number() OVER (PARTITION BY customer_id, menu_item_id ORDER BY created_on, order_id, quantity, unit_price) AS nth, '{k}' AS kind FROM (SELECT DISTINCT order_id, menu_item_id, quantity, unit_price FROM {t}) d JOIN ok USING (order_id)"


def _menu_stats(lines: str = "true", items: str = "true") -> str:
    return f""", s AS ({_BR('i', 'item')} UNION ALL {_BR('a', 'addon')}), g AS (SELECT menu_item_id, coalesce(sum(quantity) FILTER (WHERE kind = 'item'), 0.0) AS i, coalesce(sum(quantity) FILTER (WHERE kind = 'addon'), 0.0) AS a, sum(quantity) AS t, sum(revenue) AS r, coalesce(sum(quantity) FILTER (WHERE nth > 1), 0.0) AS rq, coalesce(sum(revenue) FILTER (WHERE nth > 1), 0.0) AS rr,
count(DISTINCT customer_id) AS customers, count(DISTINCT customer_id) FILTER (WHERE nth > 1) AS repeat_customers FROM s WHERE {lines} GROUP BY 1)
SELECT menu_item_id, name, type, a AS as_addon, i AS as_item, t AS total_sold, round(r, 2) AS revenue, CASE WHEN unit = 'g' THEN t * unit_value ELSE 0.0 END AS grams, 0.0::DOUBLE AS millilitres, CASE WHEN unit = 'COUNT' THEN t * unit_value ELSE 0.0 END AS pieces, round(rq, 3) AS reorder_quantity, repeat_customers, customers,
{_pct('repeat_customers', 'customers')} AS reorder_rate, {_pct('round(rr, 2)', 'round(r, 2)')} AS repeat_revenue_rate FROM m JOIN g USING (menu_item_id) WHERE {items}"""


add("A36_menu_stats", menu.menu_stats, _menu_stats())
add("A36_menu_stats_filtered", lambda s: menu.menu_stats(s, YEAR[0], None, (0, 6), "ring", "PROMO"), _menu_stats(f"bd >= DATE '{YEAR[0]}' AND dayofweek(bd) IN (0, 6)", "upper(name) LIKE '%RING%' AND type = 'PROMO'"))
_SUMMARY = lambda w: f"ln AS (SELECT DISTINCT order_id, menu_item_id, quantity, unit_price, kind FROM sold WHERE order_id IN (SELECT order_id FROM ok WHERE {w})), su AS (SELECT m.menu_item_id, name, type, is_active, coalesce(sum(quantity) FILTER (WHERE kind = 'item'), 0.0) AS as_item, coalesce(sum(quantity) FILTER (WHERE kind = 'addon'), 0.0) AS as_addon, coalesce(sum(quantity), 0.0) AS total_sold, round(coalesce(sum(quantity * unit_price), 0.0), 2) AS revenue FROM m LEFT JOIN ln ON ln.menu_item_id = m.menu_item_id GROUP BY 1, 2, 3, 4)"
add("A37_menu_summary", menu.menu_summary, f", {_SUMMARY('true')} SELECT * FROM su")
add("A37_menu_summary_since", lambda s: menu.menu_summary(s, YEAR[0]), f""", {_SUMMARY(f"bd >= DATE '{YEAR[0]}'")} SELECT * FROM su""")
add("A39_menu_matrix", menu.menu_matrix, "SELECT menu_item_id, name, type, unit, CAST(unit_value AS BIGINT) AS unit_value, price FROM m WHERE is_active")
add("A40_item_daily_weather", menu.item_daily_weather, ", d AS (SELECT bd, menu_item_id, sum(quantity) AS quantity_sold, arg_min(unit_price, (order_id, line_no, unit_price)) AS unit_price FROM i JOIN ok USING (order_id) GROUP BY 1, 2) SELECT CAST(bd AS VARCHAR) AS day, menu_item_id, quantity_sold, unit_price, temp_max FROM d LEFT JOIN w ON w.day = d.bd")
add("A41_item_volume_daily", menu.item_volume_daily, "SELECT CAST(bd AS VARCHAR) AS day, menu_item_id, round(sum(quantity * unit_value * CASE unit WHEN 'kg' THEN 1000.0::DOUBLE WHEN 'mg' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END), 3) AS volume, round(avg(unit_price), 6) AS avg_price FROM i JOIN ok USING (order_id) JOIN m USING (menu_item_id) GROUP BY 1, 2")
add("A42_mixed_units", menu.mixed_units, "SELECT name FROM m GROUP BY 1 HAVING bool_or(unit = 'COUNT') AND bool_or(unit <> 'COUNT')")
add("A43_primary_units", menu.primary_units, "SELECT name, CASE WHEN bool_or(unit = 'COUNT') THEN 'units' ELSE 'g' END AS unit FROM m GROUP BY 1")
add("A44_revenue_with_weather", lambda s: series.revenue_with_weather(s, *NOW), f", {_days(NOW)}, j AS (SELECT days.*, w.temp_max FROM days LEFT JOIN w ON days.day = w.day) SELECT CAST(day AS VARCHAR) AS day, round(revenue, 2) AS revenue, num_orders, coalesce(last_value(temp_max IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(temp_max IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS temp_max FROM j")
add("A45_recomputed_totals", customers.recomputed_totals, "SELECT customer_id, count(*) AS total_orders, round(sum(total), 2) AS total_spent, CAST(min(bd) AS VARCHAR) AS first_order, CAST(max(bd) AS VARCHAR) AS last_order FROM o GROUP BY 1")
add("A46_item_counters", menu.recalculated_counters, "SELECT menu_item_id, sum(quantity) AS total_sold, round(sum(total_price), 2) AS total_revenue, coalesce(sum(quantity) FILTER (WHERE kind = 'item'), 0.0) AS sold_as_item, coalesce(sum(quantity) FILTER (WHERE kind = 'addon'), 0.0) AS sold_as_addon FROM sold WHERE order_id IN (SELECT order_id FROM ok) GROUP BY 1")
add("A49_menu_types", menu.menu_types, "SELECT DISTINCT type FROM m")
add("A51_popular_queries", insights.popular_queries, "SELECT text AS user_query, count(*) AS freq, max(conv_id) AS last_used FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1 ORDER BY freq DESC, last_used DESC, user_query LIMIT 20")
add("A52_conversation_counts", lambda s: s.raw("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.count(F.when(F.col("role") == "user", 1)).alias("by_user"), F.max("turn").alias("last_turn")), "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS by_user, max(turn) AS last_turn FROM conversations GROUP BY 1")
add("A56_missing_days", lambda s: series.missing_days(s, *NOW), f", {_days(NOW)} SELECT CAST(day AS VARCHAR) AS day FROM days WHERE day NOT IN (SELECT bd FROM ok GROUP BY 1 HAVING count(DISTINCT order_from) >= 5)")
_CATS = ", ".join(f"round(coalesce(sum(total_price) FILTER (WHERE type = '{k}'), 0.0), 2) AS {k.lower()}" for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
add("A58_category_pivot", insights.category_pivot, f"SELECT strftime(bd, '%Y-%m') AS month, {_CATS} FROM i JOIN ok USING (order_id) JOIN m USING (menu_item_id) GROUP BY 1")
add("W2_order_rank", lambda s: customers.ranked_orders(s).select("order_id", "customer_id", "order_rank"), f", {_RANKED} SELECT order_id, customer_id, CAST(r AS INTEGER) AS order_rank FROM rk")
add("W7_revenue_features", lambda s: series.revenue_features(s, *NOW), f", {_days(NOW)} SELECT CAST(day AS VARCHAR) AS day, round(revenue, 2) AS revenue, round(lag(revenue, 1) OVER x, 2) AS lag1, round(lag(revenue, 7) OVER x, 2) AS lag7, round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS mean7, round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 4) AS mean14, round(avg(revenue) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(revenue) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING), 4) AS trend FROM days WINDOW x AS (ORDER BY day)")
_PANEL = f"sl AS (SELECT menu_item_id, bd AS day, sum(quantity) AS q FROM i JOIN ok USING (order_id) WHERE {_IN(NOW)} GROUP BY 1, 2), gr AS (SELECT menu_item_id, first, CAST(unnest(generate_series(first, DATE '{NOW[1]}', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT menu_item_id, min(day) AS first FROM sl GROUP BY 1)), panel AS (SELECT gr.menu_item_id, gr.day, first, coalesce(q, 0.0) AS q FROM gr LEFT JOIN sl USING (menu_item_id, day))"
add("M1_item_panel", lambda s: series.item_features(s, *NOW), f", {_PANEL} SELECT menu_item_id, CAST(day AS VARCHAR) AS day, q, CAST(datediff('day', first, day) AS INTEGER) AS days_since_launch, lag(q, 1) OVER x AS lag1, lag(q, 7) OVER x AS lag7, round(avg(q) OVER (PARTITION BY menu_item_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 4) AS mean7 FROM panel WINDOW x AS (PARTITION BY menu_item_id ORDER BY day)")
add("W9_store_totals", lambda s: series.store_totals(s, *NOW), f", {_PANEL}, d7 AS (SELECT day, sum(sum(q)) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS all7 FROM panel GROUP BY 1), o7 AS (SELECT *, sum(q) OVER (PARTITION BY menu_item_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS own7 FROM panel) SELECT menu_item_id, CAST(day AS VARCHAR) AS day, q, greatest(0.0, coalesce(all7, 0.0) - coalesce(own7, 0.0)) AS others7 FROM o7 JOIN d7 USING (day)")
add("W14_cumulative_revenue", lambda s: series.cumulative_revenue(s, *NOW), f", {_days(NOW)} SELECT CAST(day AS VARCHAR) AS day, round(sum(revenue) OVER (ORDER BY day), 2) AS cumulative FROM days")
add("W15_selected_moving_average", lambda s: series.selected_moving_average(s, *NOW, (0, 2, 5)), f", {_days(NOW)}, z AS (SELECT * FROM days WHERE isodow(day) - 1 IN (0, 2, 5)) SELECT CAST(day AS VARCHAR) AS day, round(avg(revenue) OVER x, 2) AS moving_average, count(*) OVER x AS days FROM z WINDOW x AS (ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
_WEEKDAY = f"fc AS (SELECT CAST(DATE '{NOW[1]}' + CAST(k AS INTEGER) AS DATE) AS target, b FROM range(1, 8) t(k), (SELECT unnest([7, 14, 21, 28]) AS b)), wf AS (SELECT CAST(target AS VARCHAR) AS day, round(avg(revenue), 2) AS forecast, count(*) AS days FROM fc JOIN days ON days.day = target - CAST(b AS INTEGER) GROUP BY 1)"
add("W17_weekday_forecast", lambda s: series.weekday_forecast(s, *NOW), f", {_days(NOW)}, {_WEEKDAY} SELECT * FROM wf")
add("O5_forecast_or_backtest", lambda s: series.forecast_or_backtest(s, *NOW, "1998-04-01"), f", {_days(NOW)}, {_WEEKDAY} SELECT CAST(day AS VARCHAR) AS day, round(revenue, 2) AS value, 'backtest' AS kind FROM days UNION ALL SELECT day, forecast, 'forecast' FROM wf")
add("W19_new_customer_average", series.new_customer_average, ", f AS (SELECT day, count(*) AS n FROM (SELECT customer_id, min(bd) AS day FROM vo GROUP BY 1) GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n AS new_customers, CASE WHEN row_number() OVER (ORDER BY day) <= 6 THEN CAST(n AS DOUBLE) ELSE round(CAST(sum(n) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS DOUBLE) / 7) END AS average FROM f")
add("X4_weekly_buckets", lambda s: series.weekly_buckets(s, *NOW), f", {_days(NOW)}, z AS (SELECT CAST(CAST(day + CAST((7 - isodow(day)) AS INTEGER) AS DATE) AS VARCHAR) AS week, sum(revenue) AS r, CAST(sum(num_orders) AS BIGINT) AS n, count(*) AS days FROM days GROUP BY 1) SELECT week, round(r, 2) AS revenue, n AS num_orders, round(r / days, 2) AS avg_revenue, round(r / nullif(n, 0), 2) AS avg_order_value FROM z")
add("X9_normal_forms", lambda s: s.customers.select("customer_id", normal_text(F.concat(F.lit("  "), "name", F.lit("   X "))).alias("name"), normal_phone(F.format_string("+91 (98) 0-%08d", "customer_id")).alias("phone")), "SELECT customer_id, lower(name) || ' x' AS name, right(regexp_replace('+91 (98) 0-' || lpad(CAST(customer_id AS VARCHAR), 8, '0'), '[^0-9]', '', 'g'), 10) AS phone FROM c")
add("X22_event_json", lambda s: s.raw("events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
add("E1_identity_keys", entities.identity_keys, "SELECT customer_id, key AS identity_key, NOT starts_with(key, 'anon:') AS is_verified FROM (SELECT customer_id, CASE WHEN customer_id % 3 = 0 THEN 'phone:' || sha256(right('91' || '98' || lpad(CAST(customer_id AS VARCHAR), 8, '0'), 10)) WHEN customer_id % 3 = 1 THEN 'addr:' || sha256(lower(name) || '|nation ' || nation) ELSE 'anon:' || sha256(CAST(customer_id AS VARCHAR)) END AS key FROM c)")
add("X14_menu_uuids", entities.menu_ids, None)
add("E7_merged_totals", entities.merged_totals, ", mg AS (SELECT customer_id AS source, customer_id // 2 AS target FROM c WHERE customer_id % 10 = 0 AND customer_id > 0 AND customer_id % 30 <> 0), chain AS (WITH RECURSIVE ch(source, survivor) AS (SELECT source, target FROM mg UNION ALL SELECT ch.source, mg.target FROM ch JOIN mg ON ch.survivor = mg.source) SELECT source, survivor FROM ch WHERE survivor NOT IN (SELECT source FROM mg)) SELECT coalesce(survivor, customer_id) AS customer_id, count(*) AS orders, round(sum(total), 2) AS spend FROM o LEFT JOIN chain ON o.customer_id = chain.source GROUP BY 1")
add("L1_orders_page", lambda s: entities.browse(s.orders.select("order_id", "customer_id", F.round("total", 2).alias("total"), "order_from"), {c: F.col(c) for c in ("order_id", "customer_id", "total", "order_from")}, "total", True, "order_id", 3, 25, {"order_from": "high"}), "SELECT order_id, customer_id, round(total, 2) AS total, order_from FROM o WHERE upper(order_from) LIKE '%HIGH%' ORDER BY round(total, 2) DESC NULLS LAST, order_id LIMIT 25 OFFSET 50")
add("F11_menu_search", lambda s: entities.browse(s.menu.select("menu_item_id", "name", "type"), {c: F.col(c) for c in ("menu_item_id", "name", "type")}, "name", False, "menu_item_id", 1, 40, {}, "ring"), "SELECT menu_item_id, name, type FROM m WHERE CAST(menu_item_id AS VARCHAR) LIKE '%RING%' OR upper(name) LIKE '%RING%' OR upper(type) LIKE '%RING%' ORDER BY name NULLS FIRST, menu_item_id LIMIT 40")
add("DQ1_violations", entities.violations, "SELECT 'lineitem.quantity > 0' AS rule, count(*) AS violations FROM lineitem WHERE l_quantity <= 0 UNION ALL SELECT 'lineitem.price >= 0', count(*) FROM lineitem WHERE l_extendedprice < 0 UNION ALL SELECT 'lineitem key unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'lineitem.order exists', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orders.customer exists', count(*) FROM o WHERE customer_id NOT IN (SELECT customer_id FROM c) UNION ALL SELECT 'orders.total >= 0', count(*) FROM o WHERE total < 0 UNION ALL SELECT 'customer.balance known', count(*) FROM customer WHERE c_acctbal IS NULL")
add("U1_similar_names", entities.similar_names, None)
add(
    "U6_name_neighbours", entities.neighbours,
    """, n AS (SELECT DISTINCT name FROM m), wd AS (SELECT name, ' ' || lower(unnest(regexp_split_to_array(trim(name), '\\s+'))) || ' ' AS p, unnest(range(1, 1 + len(regexp_split_to_array(trim(name), '\\s+')))) AS pos FROM n),
gr AS (SELECT name, pos, k, i, substr(p, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS gram FROM wd, range(2, 5) s(k), range(1, 200) r(i) WHERE i + k - 1 <= length(p)), tf AS (SELECT name, gram, count(*) AS tf FROM gr GROUP BY 1, 2),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1), ww AS (SELECT name, gram, tf * (ln((1 + (SELECT count(*) FROM n)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (gram)), un AS (SELECT name, gram, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM ww),
dt AS (SELECT a.name, b.name AS other, round(sum(a.w * b.w), 5) AS score FROM un a JOIN un b ON a.gram = b.gram AND a.name <> b.name GROUP BY 1, 2) SELECT name, other, score, CAST(row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS INTEGER) AS rank FROM dt QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, other) <= 6""",
)
add("T13_business_day_windows", lambda s: incremental.daily_windows(s.raw("events")), "SELECT CAST(CAST(ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS business_date, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
add("S10_latest_by_key", lambda s: incremental.latest(s.raw("events").select("user_id", "event_id", "event_type", F.round("value", 2).alias("value")), ["user_id"], "event_id"), "SELECT user_id, event_id, event_type, round(value, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
add("T1_incremental_pull", lambda s: incremental.page(s.raw("events").select("event_id", "user_id", "event_type"), "event_id", 5000, 500), "SELECT event_id, user_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 500")
add("N1_read_only_sql", lambda s: incremental.read_only_sql(s, "SELECT order_from, count(*) AS n FROM orders_view WHERE order_status = 'Success' GROUP BY order_from"), "SELECT order_from, count(*) AS n FROM ok GROUP BY 1")

from comanda.plans import data, forecast, loyalty, names, things  # noqa: E402, F401  registers its queries

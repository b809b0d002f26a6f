"""Registered queries on the item panel and on forecasts, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from comanda.functions.dates import text_date
from comanda.operators import demand, insights, series
from comanda.operators import panel as ops
from comanda.plans.base import NOW, TODAY, YEAR, add, days_of, inside
from comanda.session import written
from comanda.sources.adapter import Shop
from comanda.streaming import tables

_PANEL = f"""sl AS (SELECT menu_item_id, bd AS day, sum(quantity) AS q, arg_min(unit_price, (order_id, line_no, unit_price)) AS price FROM i JOIN ok USING (order_id) WHERE {inside(NOW)} GROUP BY 1, 2),
it AS (SELECT menu_item_id, min(day) AS first, arg_max(price, day) AS price FROM sl GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series(DATE '{NOW[0]}', DATE '{NOW[1]}', INTERVAL 1 DAY)) AS DATE) AS day),
we AS (SELECT cal.day, coalesce(last_value(temp_max IGNORE NULLS) OVER p, first_value(temp_max IGNORE NULLS) OVER f, 25.0) AS temperature, coalesce(last_value(rain_sum IGNORE NULLS) OVER p, first_value(rain_sum IGNORE NULLS) OVER f, 0.0) AS rain
FROM cal LEFT JOIN w ON w.day = cal.day WINDOW p AS (ORDER BY cal.day ROWS UNBOUNDED PRECEDING), f AS (ORDER BY cal.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
pn AS (SELECT it.menu_item_id, cal.day, m.type AS category, it.price, coalesce(sl.q, 0.0) AS q, temperature, rain FROM it JOIN cal ON cal.day >= it.first LEFT JOIN sl ON sl.menu_item_id = it.menu_item_id AND sl.day = cal.day LEFT JOIN m ON m.menu_item_id = it.menu_item_id JOIN we ON we.day = cal.day)"""
_B = lambda n, by="PARTITION BY menu_item_id": f"({by} ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
_FEATURES = f"""{_PANEL},
dy AS (SELECT day, sum(total) OVER {_B(3, '')} AS all3, sum(total) OVER {_B(7, '')} AS all7, coalesce(avg(mean) OVER {_B(7, '')}, 0.0) AS g7 FROM (SELECT day, sum(q) AS total, avg(q) AS mean FROM pn GROUP BY 1)),
cd AS (SELECT category, day, avg(mean) OVER {_B(7, 'PARTITION BY category')} AS c7 FROM (SELECT category, day, avg(q) AS mean FROM pn GROUP BY 1, 2)),
md AS (SELECT menu_item_id, median(price) AS med, min(day) AS first FROM pn GROUP BY 1),
raw AS (SELECT pn.*, datediff('day', md.first, pn.day) AS age, med, all3, all7, g7, coalesce(c7, g7) AS c7, lag(q, 1) OVER x AS l1, lag(q, 7) OVER x AS l7, avg(q) OVER {_B(7, 'PARTITION BY pn.menu_item_id').replace('day', 'pn.day')} AS r7, avg(q) OVER {_B(14, 'PARTITION BY pn.menu_item_id').replace('day', 'pn.day')} AS r14,
avg(q) OVER {_B(3, 'PARTITION BY pn.menu_item_id').replace('day', 'pn.day')} - avg(q) OVER (PARTITION BY pn.menu_item_id ORDER BY pn.day ROWS BETWEEN 6 PRECEDING AND 4 PRECEDING) AS t3,
coalesce(sum(q) OVER {_B(3, 'PARTITION BY pn.menu_item_id').replace('day', 'pn.day')}, 0.0) AS own3, coalesce(sum(q) OVER {_B(7, 'PARTITION BY pn.menu_item_id').replace('day', 'pn.day')}, 0.0) AS own7
FROM pn JOIN md USING (menu_item_id) JOIN dy ON dy.day = pn.day JOIN cd ON cd.day = pn.day AND cd.category IS NOT DISTINCT FROM pn.category WINDOW x AS (PARTITION BY pn.menu_item_id ORDER BY pn.day)),
ft AS (SELECT menu_item_id, day, q, CAST(isodow(day) - 1 AS DOUBLE) AS day_of_week, CASE WHEN isodow(day) >= 6 THEN 1.0 ELSE 0.0 END AS is_weekend, CAST(month(day) AS DOUBLE) AS month, CAST(age AS DOUBLE) AS days_since_launch,
CASE WHEN age < 3 THEN c7 ELSE l1 END AS lag_1, CASE WHEN age < 3 THEN c7 ELSE l7 END AS lag_7, CASE WHEN age < 3 THEN c7 ELSE r7 END AS rolling_mean_7, CASE WHEN age < 3 THEN c7 ELSE r14 END AS rolling_mean_14, CASE WHEN age < 3 THEN c7 ELSE t3 END AS rolling_trend_3,
temperature, rain, price, med AS item_median_price, CASE WHEN med > 0 THEN price / med ELSE 1.0 END AS price_ratio, c7 AS category_avg_last7, g7 AS global_avg_last7, greatest(0.0, coalesce(all3, 0.0) - own3) AS store_total_last3, greatest(0.0, coalesce(all7, 0.0) - own7) AS store_total_last7,
temperature * CASE WHEN isodow(day) >= 6 THEN 1.0 ELSE 0.0 END AS temp_weekend FROM raw),
tr AS (SELECT * FROM ft WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND rolling_mean_7 IS NOT NULL AND rolling_mean_14 IS NOT NULL AND rolling_trend_3 IS NOT NULL)"""
#: Prices are quotients that both engines divide alike; rounding would split ties.
_EXACT = ("price", "item_median_price")
_COLUMNS = ", ".join(f"CAST({c if c in _EXACT else f'round({c}, 4)'} AS DOUBLE) AS {c}" for c in ops.FEATURES)


def _panel(s: Shop):
    return ops.panel(s, *NOW)


def _features(s: Shop, training: bool = False):
    return ops.features(_panel(s), training)


def _shown(rows):
    return rows.select("menu_item_id", text_date(F.col("day")).alias("day"), "q", *[F.col(c) if c in _EXACT else F.round(c, 4).alias(c) for c in ops.FEATURES])


add("M1_dense_panel", lambda s: _panel(s).select("menu_item_id", text_date(F.col("day")).alias("day"), "category", "price", "q", "temperature", "rain"), f", {_PANEL} SELECT menu_item_id, CAST(day AS VARCHAR) AS day, category, price, q, temperature, rain FROM pn")
add("M2_features", lambda s: _shown(_features(s)), f", {_FEATURES} SELECT menu_item_id, CAST(day AS VARCHAR) AS day, q, {_COLUMNS} FROM ft")
add("M4_training_features", lambda s: _shown(_features(s, True)), f", {_FEATURES} SELECT menu_item_id, CAST(day AS VARCHAR) AS day, q, {_COLUMNS} FROM tr")
add("M3_cold_start", lambda s: _features(s).filter(f"days_since_launch < {ops.COLD_DAYS}").select("menu_item_id", text_date(F.col("day")).alias("day"), F.round("lag_1", 4).alias("lag_1"), F.round("category_avg_last7", 4).alias("prior")), f", {_FEATURES} SELECT menu_item_id, CAST(day AS VARCHAR) AS day, round(c7, 4) AS lag_1, round(c7, 4) AS prior FROM raw WHERE age < 3")


def _training_sets(s: Shop):
    classifier, regressor = ops.training_sets(_features(s, True))
    one = classifier.agg(F.count(F.lit(1)).alias("rows"), F.sum("sold").alias("positive"), F.round(F.avg("sold"), 4).alias("mean_target")).withColumn("set", F.lit("classifier"))
    return one.unionByName(regressor.agg(F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("positive"), F.round(F.avg("target"), 4).alias("mean_target")).withColumn("set", F.lit("regressor")))


add("M5_training_sets", _training_sets, f", {_FEATURES} SELECT 'classifier' AS set, count(*) AS rows, count(*) FILTER (WHERE q > 0) AS positive, round(avg(CASE WHEN q > 0 THEN 1.0 ELSE 0.0 END), 4) AS mean_target FROM tr UNION ALL SELECT 'regressor', count(*), count(*), round(avg(q), 4) FROM tr WHERE q > 0")
add(
    "M6_time_split", lambda s: ops.time_split(_features(s, True)).groupBy("part").agg(F.count(F.lit(1)).alias("rows"), text_date(F.min("day")).alias("first_day"), text_date(F.max("day")).alias("last_day")),
    f", {_FEATURES}, dd AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM tr)) SELECT CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part, count(*) AS rows, CAST(min(tr.day) AS VARCHAR) AS first_day, CAST(max(tr.day) AS VARCHAR) AS last_day FROM tr JOIN dd USING (day) GROUP BY 1",
)


def _volume_targets(s: Shop):
    regressor = ops.volume_training_sets(ops.volume_panel(_panel(s), s.menu))[1]
    return regressor.select("menu_item_id", text_date(F.col("day")).alias("day"), F.round("scale", 4).alias("scale"), F.round("target", 6).alias("target"))


add(
    "M5_volume_targets", _volume_targets,
    f""", {_FEATURES}, vo_ AS (SELECT pn.menu_item_id, pn.day, pn.q * unit_value * CASE unit WHEN 'kg' THEN 1000.0::DOUBLE WHEN 'mg' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS v FROM pn JOIN m USING (menu_item_id)),
sc AS (SELECT menu_item_id, greatest(coalesce(median(v) FILTER (WHERE v > 0), 1.0), 1e-6) AS scale FROM vo_ GROUP BY 1)
SELECT menu_item_id, CAST(day AS VARCHAR) AS day, round(scale, 4) AS scale, round(v / scale, 6) AS target FROM tr JOIN vo_ USING (menu_item_id, day) JOIN sc USING (menu_item_id) WHERE v > 0""",
)
add("W11_item_transforms", lambda s: ops.item_transforms(_panel(s)).select("menu_item_id", "first_day", "median_price", "median_positive"), f", {_PANEL} SELECT menu_item_id, CAST(min(day) AS VARCHAR) AS first_day, median(price) AS median_price, median(q) FILTER (WHERE q > 0) AS median_positive FROM pn GROUP BY 1")
add(
    "W12_last_prices", lambda s: ops.item_sales(s, *NOW).groupBy("menu_item_id").agg(F.max_by("price", "day").alias("last_price"), text_date(F.min("day")).alias("first_day"), F.min_by("q", "day").alias("first_quantity")),
    f", {_PANEL} SELECT menu_item_id, arg_max(price, day) AS last_price, CAST(min(day) AS VARCHAR) AS first_day, arg_min(q, day) AS first_quantity FROM sl GROUP BY 1",
)
add(
    "W10_mean_priors", lambda s: _features(s).select(text_date(F.col("day")).alias("day"), "menu_item_id", F.round("global_avg_last7", 4).alias("global_mean"), F.round("category_avg_last7", 4).alias("category_mean")),
    f", {_FEATURES} SELECT CAST(day AS VARCHAR) AS day, menu_item_id, round(g7, 4) AS global_mean, round(c7, 4) AS category_mean FROM raw",
)
add(
    "W9_store_rest", lambda s: _features(s).select(text_date(F.col("day")).alias("day"), "menu_item_id", F.col("store_total_last3").alias("rest3"), F.col("store_total_last7").alias("rest7")),
    f", {_FEATURES} SELECT CAST(day AS VARCHAR) AS day, menu_item_id, store_total_last3 AS rest3, store_total_last7 AS rest7 FROM ft",
)
_GUESS = f"{_FEATURES}, gs AS (SELECT *, least(1.0::DOUBLE, round(rolling_mean_14 / 10, 3)) AS pr, rolling_mean_7 AS p50, greatest(rolling_mean_7, rolling_mean_14) AS p90 FROM tr)"
add(
    "M8_forecast_metrics", lambda s: ops.forecast_metrics(ops.with_guess(_features(s, True))),
    f""", {_GUESS}, sc AS (SELECT pr, count(*) FILTER (WHERE q > 0) AS pos, count(*) FILTER (WHERE NOT q > 0) AS neg FROM gs GROUP BY 1)
SELECT (SELECT round(sum(a.pos * b.neg * CASE WHEN a.pr > b.pr THEN 1.0::DOUBLE WHEN a.pr = b.pr THEN 0.5 ELSE 0.0 END) / nullif((SELECT sum(pos) FROM sc) * (SELECT sum(neg) FROM sc), 0), 4) FROM sc a, sc b) AS auc,
round(avg(CASE WHEN (q > 0) = (pr >= 0.5) THEN 1.0 ELSE 0.0 END), 4) AS accuracy, round(coalesce(count(*) FILTER (WHERE q > 0 AND pr >= 0.5) / nullif(count(*) FILTER (WHERE pr >= 0.5), 0), 0.0), 4) AS precision, round(coalesce(count(*) FILTER (WHERE q > 0 AND pr >= 0.5) / nullif(count(*) FILTER (WHERE q > 0), 0), 0.0), 4) AS recall,
round(avg(abs(q - p50)) FILTER (WHERE q > 0), 4) AS mae_p50, round(sqrt(avg((q - p50) * (q - p50)) FILTER (WHERE q > 0)), 4) AS rmse_p50, round(avg(abs(q - p90)) FILTER (WHERE q > 0), 4) AS mae_p90, round(avg(CASE WHEN q <= p90 THEN 1.0 ELSE 0.0 END) FILTER (WHERE q > 0), 4) AS p90_coverage FROM gs""",
)
add(
    "U9_business_cost", lambda s: ops.business_cost(ops.with_guess(_features(s, True))),
    f", {_GUESS}, z AS (SELECT sum(greatest(q - p50, 0.0)) AS s, sum(greatest(p50 - q, 0.0)) AS wa FROM gs) SELECT round(s, 3) AS stockout_units, round(wa, 3) AS waste_units, round(2.0::DOUBLE * s, 3) AS stockout_cost, round(wa, 3) AS waste_cost, round(2.0::DOUBLE * s + wa, 3) AS total_cost FROM z",
)


def _folds(s: Shop):
    folds = insights.calendar(s, "1998-03-02", NOW[1])
    return ops.point_in_time(_panel(s), folds, folds.filter("day > date'1998-03-28'"))


add(
    "M11_point_in_time", lambda s: _folds(s).select("menu_item_id", text_date(F.col("day")).alias("day"), F.round("predicted", 4).alias("predicted"), "actual"),
    f""", {_PANEL} SELECT p.menu_item_id, CAST(p.day AS VARCHAR) AS day, round(coalesce(avg(h.q), 0.0), 4) AS predicted, any_value(p.q) AS actual
FROM pn p LEFT JOIN pn h ON h.menu_item_id = p.menu_item_id AND datediff('day', h.day, p.day) IN (7, 14, 21, 28) WHERE p.day BETWEEN DATE '1998-03-02' AND DATE '1998-03-28' GROUP BY p.menu_item_id, p.day""",
)
add("M12_active_items", lambda s: ops.active_items(s, TODAY), f"SELECT DISTINCT menu_item_id FROM i JOIN ok USING (order_id) WHERE bd BETWEEN DATE '{TODAY}' - 14 AND DATE '{TODAY}' - 1")
add("M13_future_weather", lambda s: ops.future_weather(s, TODAY), f"SELECT round(coalesce(avg(temp_max), 25.0), 4) AS temperature, round(coalesce(avg(rain_sum), 0.0), 4) AS rain, count(*) AS days FROM (SELECT * FROM w WHERE day < DATE '{TODAY}' ORDER BY day DESC LIMIT 7)")
add("W18_weather_before_any", lambda s: ops.future_weather(s, "1990-01-01"), "SELECT 25.0::DOUBLE AS temperature, 0.0::DOUBLE AS rain, CAST(0 AS BIGINT) AS days")
_FORECAST = f"{_PANEL}, fc AS (SELECT it.menu_item_id, n, avg(pn.q) AS predicted FROM it, range(1, 15) t(n) LEFT JOIN pn ON pn.menu_item_id = it.menu_item_id AND datediff('day', pn.day, DATE '{NOW[1]}' + CAST(n AS INTEGER)) IN (7, 14, 21, 28) GROUP BY 1, 2)"
add("W16_cumulative_horizons", lambda s: ops.cumulative_horizons(ops.item_forecast(_panel(s), NOW[1])), f", {_FORECAST} SELECT menu_item_id, {', '.join(f'round(sum(coalesce(predicted, 0.0)) FILTER (WHERE n <= {h}), 4) AS next_{h}' for h in ops.HORIZONS)} FROM fc GROUP BY 1")
_MODELS = f"""{days_of(NOW)}, ms AS (SELECT day, model, value FROM (SELECT day, lag(revenue, 7) OVER (ORDER BY day) AS last_week, avg(revenue) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7, (lag(revenue, 7) OVER (ORDER BY day) + lag(revenue, 14) OVER (ORDER BY day) + lag(revenue, 21) OVER (ORDER BY day)) / 3 AS weekday FROM days)
UNPIVOT (value FOR model IN (last_week, mean_7, weekday)))"""


def _days(s: Shop):
    return insights.dense_days(s, *NOW)


add(
    "J20_actual_and_predicted", lambda s: ops.actual_and_predicted(_days(s), ops.model_series(_days(s)), ("last_week", "weekday")),
    f", {_MODELS} SELECT CAST(days.day AS VARCHAR) AS day, x.model, round(revenue, 2) AS actual, round(value, 2) AS predicted, round(value - revenue, 2) AS error FROM days CROSS JOIN (SELECT unnest(['last_week', 'weekday']) AS model) x LEFT JOIN ms ON ms.day = days.day AND ms.model = x.model",
)


def _merged(s: Shop):
    said = ops.model_series(_days(s))
    one = lambda m, lo, hi: said.filter((F.col("model") == m) & F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).select("day", "value")
    actual = _days(s).filter("day < date'1998-03-15'").select("day", F.col("revenue").alias("value"))
    return ops.merged_series({"actual": actual, "mean_7": one("mean_7", "1998-02-01", "1998-03-20"), "weekday": one("weekday", "1998-03-10", NOW[1]), "last_week": one("last_week", "1998-01-10", "1998-01-20")})


add(
    "J15_merged_series", _merged,
    f""", {_MODELS}, un AS (SELECT day, 'actual' AS k, revenue AS value FROM days WHERE day < DATE '1998-03-15' UNION ALL SELECT * FROM ms WHERE model = 'mean_7' AND day BETWEEN DATE '1998-02-01' AND DATE '1998-03-20' UNION ALL SELECT * FROM ms WHERE model = 'weekday' AND day >= DATE '1998-03-10' UNION ALL SELECT * FROM ms WHERE model = 'last_week' AND day BETWEEN DATE '1998-01-10' AND DATE '1998-01-20')
SELECT CAST(day AS VARCHAR) AS day, {', '.join(f"round(max(value) FILTER (WHERE k = '{k}'), 2) AS {k}" for k in ('actual', 'mean_7', 'weekday', 'last_week'))} FROM un GROUP BY 1""",
)
_RUNS = ("1998-03-01", "1998-03-08", "1998-03-15")
_CACHE = f"{_MODELS}, ca AS (" + " UNION ALL ".join(f"SELECT day AS forecast_date, model, DATE '{g}' AS generated_on, value FROM ms WHERE day BETWEEN DATE '{g}' AND DATE '{g}' + 6 {'' if k == 0 else 'AND model >= ' + repr('mean_7')}" for k, g in enumerate(_RUNS)) + ")"


def _cache(s: Shop):
    return ops.forecast_cache(_days(s), _RUNS)


add("A55_cache_freshness", lambda s: ops.cache_freshness(_cache(s), "1998-03-15"), f", {_CACHE} SELECT count(*) FILTER (WHERE generated_on = DATE '1998-03-15') AS rows_today, CAST(max(generated_on) AS VARCHAR) AS latest, CAST(max(generated_on) FILTER (WHERE generated_on < DATE '1998-03-15') AS VARCHAR) AS previous, count(*) FILTER (WHERE generated_on = DATE '1998-03-15') > 0 AS is_fresh FROM ca")
add(
    "M20_latest_complete_run", lambda s: ops.latest_complete(_cache(s), 3, "last_week").select(text_date(F.col("generated_on")).alias("generated_on"), text_date(F.col("forecast_date")).alias("forecast_date"), "model", F.round("value", 2).alias("value")),
    f", {_CACHE} SELECT CAST(generated_on AS VARCHAR) AS generated_on, CAST(forecast_date AS VARCHAR) AS forecast_date, model, round(value, 2) AS value FROM ca WHERE generated_on = (SELECT max(g) FROM (SELECT generated_on AS g FROM ca GROUP BY 1 HAVING count(DISTINCT model) >= 3 AND bool_or(model = 'last_week')))",
)
add(
    "A56_incomplete_dates", lambda s: ops.incomplete_dates(_cache(s), insights.calendar(s, "1998-02-26", "1998-03-25"), ("last_week", "mean_7", "weekday")),
    f", {_CACHE}, ex AS (SELECT CAST(unnest(generate_series(DATE '1998-02-26', DATE '1998-03-25', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(day AS VARCHAR) AS day, count(*) AS missing_models FROM ex, (SELECT unnest(['last_week', 'mean_7', 'weekday']) AS model) x WHERE NOT EXISTS (SELECT 1 FROM ca WHERE forecast_date = ex.day AND ca.model = x.model) GROUP BY 1",
)
_WEEKDAY = f"fcw AS (SELECT DATE '{NOW[1]}' + CAST(k AS INTEGER) AS target, avg(revenue) AS f FROM range(1, 8) t(k) JOIN days ON datediff('day', days.day, DATE '{NOW[1]}' + CAST(k AS INTEGER)) IN (7, 14, 21, 28) GROUP BY 1)"
add("M23_projection", lambda s: ops.projection_total(series.weekday_forecast(s, *NOW)), f", {days_of(NOW)}, {_WEEKDAY} SELECT round(sum(round(f, 2)), 2) AS projected, count(*) AS days FROM fcw")
add(
    "M22_stale_models", lambda s: s.orders.select("order_id", ops.is_stale(F.date_sub("business_date", (F.col("order_id") % 3).cast("int")), F.col("created_on")).alias("is_stale")),
    "SELECT order_id, hour(created_on) >= 5 AND bd - CAST(order_id % 3 AS INTEGER) < CAST(created_on - INTERVAL 5 HOUR AS DATE) - 1 AS is_stale FROM o",
)


def _demand(s: Shop):
    panel = written(_panel(s), "panel")
    rows = ops.written_features(panel)
    return panel, rows, demand.trained(rows, ready=True)


def _backtest(s: Shop, days: int = 30):
    """The last days, in sample."""
    _, rows, model = _demand(s)
    last = rows.filter(F.col("day") > F.date_sub(F.lit(NOW[1]).cast("date"), days))
    said = demand.combined(model.predicted(last))
    return said.select("menu_item_id", text_date(F.col("day")).alias("day"), "q", F.round("probability", 4).alias("probability"), F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"), "prep")


def _forecast(s: Shop):
    panel, _, model = _demand(s)
    said = demand.forecast(panel, model, NOW[1])
    return said.select("menu_item_id", text_date(F.col("day")).alias("day"), F.round("probability", 4).alias("probability"), F.round("p50", 2).alias("p50"), F.round("p90", 2).alias("p90"), "prep")


def _next_day(s: Shop):
    """Features of the day after the panel from the carried state."""
    rows = demand.next_features(demand.carried(_panel(s).filter(F.col("day") < F.lit(NOW[1]).cast("date"))), NOW[1], 25.0, 1.0)
    return rows.select("menu_item_id", *[F.col(c) if c in _EXACT else F.round(c, 4).alias(c) for c in ops.FEATURES])


add("M6_demand_metrics", lambda s: ops.forecast_metrics(demand.held_out(ops.written_features(written(_panel(s), "panel")))), None)
add("M10_in_sample_backtest", _backtest, None)
add("M9_demand_forecast", _forecast, None)
_NEXT = ", ".join("25.0 AS temperature" if c == "temperature" else "1.0 AS rain" if c == "rain" else f"CASE WHEN isodow(DATE '{NOW[1]}') >= 6 THEN 25.0 ELSE 0.0 END AS temp_weekend" if c == "temp_weekend" else f"CAST(coalesce({c if c in _EXACT else f'round({c}, 4)'}) AS DOUBLE) AS {c}" for c in ops.FEATURES)
add("M9_next_day_features", _next_day, f", {_FEATURES} SELECT menu_item_id, {_NEXT} FROM ft WHERE day = DATE '{NOW[1]}' AND menu_item_id IN (SELECT menu_item_id FROM pn WHERE day < DATE '{NOW[1]}')")
add(
    "M9_demand_arithmetic", lambda s: demand.combined(ops.with_guess(_features(s, True)).select("menu_item_id", text_date(F.col("day")).alias("day"), F.round("probability", 3).alias("probability"), F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))).select("menu_item_id", "day", "probability", F.round("p50", 3).alias("p50"), F.round("p90", 3).alias("p90"), F.ceil(F.round(F.col("p90") * 0.7 + F.col("p50") * 0.3, 6)).alias("prep")),
    f""", {_FEATURES}, gs AS (SELECT menu_item_id, day, least(1.0, round(rolling_mean_14 / 10, 3)) AS p, round(rolling_mean_7, 4) AS lo, round(greatest(rolling_mean_7, rolling_mean_14), 4) AS hi FROM tr)
SELECT menu_item_id, CAST(day AS VARCHAR) AS day, p AS probability, round(p * lo, 3) AS p50, round(p * greatest(lo, hi), 3) AS p90, CAST(ceil(round(p * greatest(lo, hi) * 0.7 + p * lo * 0.3, 6)) AS BIGINT) AS prep FROM gs""",
)
add(
    "E17_weather_upsert", lambda s: tables.upserted(tables.upserted(s.weather.select("day", F.when(F.dayofmonth("day") % 3 != 0, F.col("temp_max")).alias("temp_max"), "rain_sum"), s.weather.select("day", F.lit(20.0).alias("temp_max"), F.lit(1.0).alias("rain_sum")), ["day"], keep=["temp_max", "rain_sum"]), s.weather.filter(F.dayofmonth("day") % 5 == 0).select("day", (F.col("temp_max") + 1).alias("temp_max"), F.lit(None).cast("double").alias("rain_sum")), ["day"]).withColumn("day", text_date(F.col("day"))),
    "SELECT CAST(day AS VARCHAR) AS day, CASE WHEN day(day) % 5 = 0 THEN temp_max + 1 WHEN day(day) % 3 = 0 THEN 20.0 ELSE temp_max END AS temp_max, rain_sum FROM w",
)

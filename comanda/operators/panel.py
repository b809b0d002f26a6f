"""The item panel and what is made from it: features, training sets, metrics, folds and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from comanda.functions.dates import text_date
from comanda.operators.menu import unit_factor
from comanda.operators.series import one_series
from comanda.session import spread, written
from comanda.sources.adapter import Shop

LAGS = ["lag_1", "lag_7", "rolling_mean_7", "rolling_mean_14", "rolling_trend_3"]
#: The order that models take their features in.
FEATURES = [
    "day_of_week", "is_weekend", "month", "days_since_launch", *LAGS, "temperature", "rain", "price", "item_median_price", "price_ratio",
    "category_avg_last7", "global_avg_last7", "store_total_last3", "store_total_last7", "temp_weekend",
]
DEFAULT_TEMPERATURE, DEFAULT_RAIN = 25.0, 0.0
COLD_DAYS = 3
HORIZONS = (1, 2, 3, 5, 7, 10, 14)
STOCKOUT_COST, WASTE_COST = 2.0, 1.0


def _date(day: str) -> Column:
    return F.lit(day).cast("date")


def item_sales(shop: Shop, start: str, end: str) -> DataFrame:
    """menu_item_id, day, q and the price of the day's first line."""
    days = shop.success.filter(F.col("business_date").between(_date(start), _date(end))).select("order_id", F.col("business_date").alias("day"))
    rows = shop.items.join(days, "order_id").groupBy("menu_item_id", "day")
    return rows.agg(F.sum("quantity").alias("q"), F.min_by("unit_price", F.struct("order_id", "line_no", "unit_price")).alias("price"))


def filled_weather(shop: Shop, start: Column, end: str) -> DataFrame:
    """A row for every day: the last known weather, else the next, else the defaults."""
    days = shop.spark.range(1).select(F.explode(F.sequence(start, _date(end))).alias("day"))
    past, later = one_series().rowsBetween(Window.unboundedPreceding, 0), one_series().rowsBetween(0, Window.unboundedFollowing)
    fill = lambda c, default: F.coalesce(F.last(c, ignorenulls=True).over(past), F.first(c, ignorenulls=True).over(later), F.lit(default))
    return days.join(shop.weather, "day", "left").select("day", fill("temp_max", DEFAULT_TEMPERATURE).alias("temperature"), fill("rain_sum", DEFAULT_RAIN).alias("rain"))


def panel(shop: Shop, start: str, end: str) -> DataFrame:
    """Every item on every day since its first sale: q (0 where none), its last price, category, weather."""
    sales = item_sales(shop, start, end)
    items = sales.groupBy("menu_item_id").agg(F.min("day").alias("first"), F.max_by("price", "day").alias("price"))
    items = items.join(shop.menu.select("menu_item_id", F.col("type").alias("category")), "menu_item_id", "left")
    grid = items.select("menu_item_id", "category", "price", "first", F.explode(F.sequence("first", _date(end))).alias("day"))
    dense = grid.join(sales.select("menu_item_id", "day", "q"), ["menu_item_id", "day"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    return dense.join(F.broadcast(filled_weather(shop, _date(start), end)), "day")  # a row a day


def _by_item() -> WindowSpec:
    return Window.partitionBy("menu_item_id").orderBy("day")


def _shifted(value: str, fun, rows: int, over: WindowSpec) -> Column:
    """``fun`` of the ``rows`` rows before this one."""
    return fun(value).over(over.rowsBetween(-rows, -1))


def priors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by day: store totals and the mean item of the 7 days before; by category and day: its mean item)."""
    daily = rows.groupBy("day").agg(F.sum("q").alias("total"), F.avg("q").alias("mean"))
    store = daily.select("day", _shifted("total", F.sum, 3, one_series()).alias("all3"), _shifted("total", F.sum, 7, one_series()).alias("all7"), F.coalesce(_shifted("mean", F.avg, 7, one_series()), F.lit(0.0)).alias("global_avg_last7"))
    kinds = rows.groupBy("category", "day").agg(F.avg("q").alias("mean"))
    kinds = kinds.select("category", "day", _shifted("mean", F.avg, 7, Window.partitionBy("category").orderBy("day")).alias("own"))
    return store, kinds


def features(rows: DataFrame, training: bool = False, n_rows: int | None = None) -> DataFrame:
    """``panel`` rows with FEATURES. Lags of an item's first COLD_DAYS days are its category's mean;
    for training, rows that still lack one go. Where ``n_rows`` tells how many rows there are, tasks follow it."""
    store, kinds = priors(rows)
    if n_rows is not None:
        rows = spread(rows, n_rows, "menu_item_id")
    item = _by_item()
    weekend = F.when(F.weekday("day") >= 5, 1).otherwise(0)
    own = lambda n: F.coalesce(_shifted("q", F.sum, n, item), F.lit(0.0))
    mean = lambda lo, hi: F.avg("q").over(item.rowsBetween(lo, hi))
    median = F.percentile("price", 0.5).over(Window.partitionBy("menu_item_id"))
    out = rows.select(
        "menu_item_id", "day", "q", "category", "price", "temperature", "rain",
        F.weekday("day").alias("day_of_week"), weekend.alias("is_weekend"), F.month("day").alias("month"), F.datediff("day", F.min("day").over(Window.partitionBy("menu_item_id"))).alias("days_since_launch"),
        F.lag("q", 1).over(item).alias("lag_1"), F.lag("q", 7).over(item).alias("lag_7"), mean(-7, -1).alias("rolling_mean_7"), mean(-14, -1).alias("rolling_mean_14"), (mean(-3, -1) - mean(-6, -4)).alias("rolling_trend_3"),
        own(3).alias("own3"), own(7).alias("own7"), median.alias("item_median_price"), (F.col("temperature") * weekend).alias("temp_weekend"),
    )
    out = out.withColumn("price_ratio", F.when(F.col("item_median_price") > 0, F.col("price") / F.col("item_median_price")).otherwise(1.0))
    # a row a day, and a row a day and category
    out = out.join(F.broadcast(store), "day").join(F.broadcast(kinds), (out["category"].eqNullSafe(kinds["category"])) & (out["day"] == kinds["day"]), "left").drop(kinds["category"]).drop(kinds["day"])
    rest = lambda n: F.greatest(F.lit(0.0), F.coalesce(F.col(f"all{n}"), F.lit(0.0)) - F.col(f"own{n}"))
    out = out.withColumn("category_avg_last7", F.coalesce("own", "global_avg_last7")).withColumn("store_total_last3", rest(3)).withColumn("store_total_last7", rest(7))
    for c in LAGS:
        out = out.withColumn(c, F.when(F.col("days_since_launch") < COLD_DAYS, F.col("category_avg_last7")).otherwise(F.col(c)))
    out = out.select("menu_item_id", "day", "q", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return out.dropna(subset=LAGS) if training else out


def written_features(rows: DataFrame) -> DataFrame:
    """``features`` for training of a written panel, written: in tasks and files by its rows. A dense panel has
    many rows of few bytes, by whose size alone a few tasks would make and later read it."""
    return written(features(rows, True, rows.count()), "demand")


def training_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for the classifier with ``sold``, rows for the regressor with ``target``): all of
    ``features``, and those that sold."""
    return rows.withColumn("sold", (F.col("q") > 0).cast("int")), rows.filter("q > 0").withColumn("target", F.col("q"))


def volume_panel(rows: DataFrame, menu: DataFrame) -> DataFrame:
    """``panel`` with ``q`` in grams, millilitres or pieces, by ``menu(menu_item_id, unit, unit_value)``; an item
    without a unit's value has no volume."""
    sizes = menu.select("menu_item_id", (F.coalesce("unit_value", F.lit(0)) * unit_factor(F.col("unit"))).alias("_size"))
    return rows.join(sizes, "menu_item_id", "left").withColumn("q", F.col("q") * F.coalesce("_size", F.lit(0.0))).drop("_size")


def volume_scales(rows: DataFrame) -> DataFrame:
    """Each item's median volume on days that sold it: 1 for items never sold, and no less than 1e-6."""
    return rows.groupBy("menu_item_id").agg(F.greatest(F.coalesce(F.median(F.when(F.col("q") > 0, F.col("q"))), F.lit(1.0)), F.lit(1e-6)).alias("scale"))


def volume_training_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``training_sets`` of a ``volume_panel``: the regressor's target is the volume by its item's ``scale``, so
    that pieces and grams are learned together. A scale needs one item's days alone."""
    classifier, regressor = training_sets(features(rows, training=True).join(volume_scales(rows), "menu_item_id"))
    return classifier, regressor.withColumn("target", F.col("q") / F.col("scale"))


def volume_demand(probability: Column, p50: Column, p90: Column, scale: Column) -> Column:
    """p50, p90 and what to prepare, as volumes: quantiles of targets, none below 0 or crossed, times scale and
    probability; to prepare are 0.7 of p90 and 0.3 of p50, rounded up."""
    zero = F.lit(0.0)
    low = F.greatest(zero, p50)
    p50, p90 = probability * low * scale, probability * F.greatest(zero, p90, low) * scale
    return F.struct(p50.alias("p50"), p90.alias("p90"), F.ceil(p90 * 0.7 + p50 * 0.3).alias("prep"))


def time_split(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """``rows`` with ``part``: train for the first ``share`` of the distinct days, test for the rest."""
    days = rows.select("day").distinct()
    place = days.select("day", F.row_number().over(one_series()).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))  # a row a day
    return rows.join(F.broadcast(place.select("day", F.when(F.col("k") <= F.floor(F.col("n") * share), "train").otherwise("test").alias("part"))), "day")


def item_transforms(rows: DataFrame) -> DataFrame:
    """First day, median price and median of the positive quantities of every item."""
    return rows.groupBy("menu_item_id").agg(text_date(F.min("day")).alias("first_day"), F.percentile("price", 0.5).alias("median_price"), F.percentile(F.when(F.col("q") > 0, F.col("q")), 0.5).alias("median_positive"))


def with_guess(rows: DataFrame) -> DataFrame:
    """A baseline's answers on ``features``: probability of a sale, p50 and p90, from the rolling means."""
    probability = F.least(F.lit(1.0), F.round(F.col("rolling_mean_14") / 10, 3))
    return rows.select("*", probability.alias("probability"), F.col("rolling_mean_7").alias("p50"), F.greatest(F.col("rolling_mean_7"), F.col("rolling_mean_14")).alias("p90"))


def forecast_metrics(rows: DataFrame) -> DataFrame:
    """AUC, accuracy, precision and recall of ``probability`` for q > 0; MAE, RMSE and coverage on the
    rows that sold.

    Ranks come from counts by probability, rounded to three places, so no task ranks all rows.
    """
    sold, said = F.col("q") > 0, F.col("probability") >= 0.5
    n = lambda c: F.count(F.when(c, 1))
    by_score = rows.groupBy(F.round("probability", 3).alias("score")).agg(n(sold).alias("pos"), n(~sold).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(F.lit(1)).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 1001 rows at most
    ranked = by_score.withColumn("won", F.col("pos") * (below + F.col("neg") / 2)).agg(F.round(F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 4).alias("auc"))
    error, high = F.col("q") - F.col("p50"), F.col("q") - F.col("p90")
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    flat = rows.agg(
        ratio(n(sold == said), F.count(F.lit(1))).alias("accuracy"), ratio(n(sold & said), n(said)).alias("precision"), ratio(n(sold & said), n(sold)).alias("recall"),
        F.round(F.avg(F.when(sold, F.abs(error))), 4).alias("mae_p50"), F.round(F.sqrt(F.avg(F.when(sold, error * error))), 4).alias("rmse_p50"), F.round(F.avg(F.when(sold, F.abs(high))), 4).alias("mae_p90"), F.round(F.avg(F.when(sold, (high <= 0).cast("int"))), 4).alias("p90_coverage"),
    )
    return flat.join(F.broadcast(ranked))  # a row each


def business_cost(rows: DataFrame, predicted: str = "p50") -> DataFrame:
    """Units short and wasted, and their costs: a unit short costs twice a wasted one."""
    short, waste = F.greatest(F.col("q") - F.col(predicted), F.lit(0.0)), F.greatest(F.col(predicted) - F.col("q"), F.lit(0.0))
    sums = rows.agg(F.sum(short).alias("s"), F.sum(waste).alias("w"))
    return sums.select(F.round("s", 3).alias("stockout_units"), F.round("w", 3).alias("waste_units"), F.round(F.col("s") * STOCKOUT_COST, 3).alias("stockout_cost"), F.round(F.col("w") * WASTE_COST, 3).alias("waste_cost"), F.round(F.col("s") * STOCKOUT_COST + F.col("w") * WASTE_COST, 3).alias("total_cost"))


def weekday_predictions(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """menu_item_id, day, predicted for ``targets(menu_item_id, day, known)``: the mean of the days
    7, 14, 21 and 28 before, as far as they lie before ``known``, 0 where none does."""
    asked = targets.select("menu_item_id", "day", "known", F.explode(F.array(*map(F.lit, (7, 14, 21, 28)))).alias("back")).withColumn("from", F.date_sub("day", F.col("back")))
    have = rows.select("menu_item_id", F.col("day").alias("from"), "q")
    met = asked.filter("from < known").join(have, ["menu_item_id", "from"])
    means = met.groupBy("menu_item_id", "day").agg(F.avg("q").alias("predicted"))
    return targets.select("menu_item_id", "day").join(means, ["menu_item_id", "day"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0.0)))


def point_in_time(rows: DataFrame, folds: DataFrame, done: DataFrame) -> DataFrame:
    """Each fold day predicted from the days before it alone, for ``folds(day)`` that ``done(day)``
    lacks; every item known before the day has a row, with what it sold."""
    open_days = folds.join(done, "day", "left_anti")
    targets = rows.join(F.broadcast(open_days), "day").select("menu_item_id", "day", F.col("day").alias("known"))  # a row a fold
    return weekday_predictions(rows, targets).join(rows.select("menu_item_id", "day", F.col("q").alias("actual")), ["menu_item_id", "day"])


def active_items(shop: Shop, today: str, days: int = 14) -> DataFrame:
    recent = shop.success.filter(F.col("business_date").between(F.date_sub(_date(today), days), F.date_sub(_date(today), 1))).select("order_id")
    return shop.items.join(recent, "order_id", "left_semi").select("menu_item_id").distinct()


def future_weather(shop: Shop, today: str, days: int = 7) -> DataFrame:
    """Means of the last days with weather before ``today``; the defaults where there is none."""
    last = shop.weather.filter(F.col("day") < _date(today)).orderBy(F.desc("day")).limit(days)
    return last.agg(F.round(F.coalesce(F.avg("temp_max"), F.lit(DEFAULT_TEMPERATURE)), 4).alias("temperature"), F.round(F.coalesce(F.avg("rain_sum"), F.lit(DEFAULT_RAIN)), 4).alias("rain"), F.count(F.lit(1)).alias("days"))


def item_forecast(rows: DataFrame, end: str, horizon: int = 14) -> DataFrame:
    """menu_item_id, day, predicted for the days after ``end``."""
    items = rows.select("menu_item_id").distinct()
    targets = items.select("menu_item_id", F.explode(F.sequence(F.date_add(_date(end), 1), F.date_add(_date(end), horizon))).alias("day")).withColumn("known", F.date_add(_date(end), 1))
    return weekday_predictions(rows, targets)


def cumulative_horizons(forecast: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Sums of every item's first n forecast days, a column for each n."""
    nth = forecast.withColumn("n", F.row_number().over(_by_item()))
    return nth.groupBy("menu_item_id").agg(*[F.round(F.sum(F.when(F.col("n") <= h, F.col("predicted"))), 4).alias(f"next_{h}") for h in horizons])


def model_series(days: DataFrame) -> DataFrame:
    """day, model, value on ``days(day, revenue)``: three simple models of the same day, from earlier ones."""
    models = {"last_week": F.lag("revenue", 7).over(one_series()), "mean_7": F.avg("revenue").over(one_series().rowsBetween(-7, -1)), "weekday": (F.lag("revenue", 7).over(one_series()) + F.lag("revenue", 14).over(one_series()) + F.lag("revenue", 21).over(one_series())) / 3}
    wide = days.select("day", *[m.alias(k) for k, m in models.items()])
    return wide.unpivot("day", list(models), "model", "value").filter("value is not null")


def actual_and_predicted(days: DataFrame, predictions: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Every day with every model: the actual revenue, the prediction and its error where there is one."""
    asked = days.select("day", "revenue", F.explode(F.array(*map(F.lit, models))).alias("model"))
    rows = asked.join(predictions, ["day", "model"], "left")
    return rows.select(text_date(F.col("day")).alias("day"), "model", F.round("revenue", 2).alias("actual"), F.round("value", 2).alias("predicted"), F.round(F.col("value") - F.col("revenue"), 2).alias("error"))


def merged_series(series: dict[str, DataFrame]) -> DataFrame:
    """Series of (day, value) as columns of one table by day, whatever days each has."""
    out = None
    for name, rows in series.items():
        one = rows.select("day", F.round("value", 2).alias(name))
        out = one if out is None else out.join(one, "day", "full_outer")
    return out.withColumn("day", text_date(F.col("day")))


def forecast_cache(days: DataFrame, generated: tuple[str, ...], horizon: int = 7) -> DataFrame:
    """forecast_date, model, generated_on, value: what the models said on each day of ``generated``
    about the days after it; the later the day, the fewer models got done."""
    said = model_series(days)
    runs = [said.filter(F.col("day").between(_date(g), F.date_add(_date(g), horizon - 1)) & (F.col("model") >= F.lit("last_week" if k == 0 else "mean_7"))).withColumn("generated_on", _date(g)) for k, g in enumerate(generated)]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.select(F.col("day").alias("forecast_date"), "model", "generated_on", "value")


def cache_freshness(cache: DataFrame, today: str) -> DataFrame:
    """Rows of ``today``, the latest run, and the latest before today."""
    g = F.col("generated_on")
    return cache.agg(F.count(F.when(g == _date(today), 1)).alias("rows_today"), text_date(F.max(g)).alias("latest"), text_date(F.max(F.when(g < _date(today), g))).alias("previous"), (F.count(F.when(g == _date(today), 1)) > 0).alias("is_fresh"))


def latest_complete(cache: DataFrame, models: int, needed: str) -> DataFrame:
    """The rows of the latest run that has at least so many models, the needed one among them."""
    runs = cache.groupBy("generated_on").agg(F.countDistinct("model").alias("n"), F.max((F.col("model") == needed).cast("int")).alias("has"))
    best = runs.filter((F.col("n") >= models) & (F.col("has") == 1)).agg(F.max("generated_on").alias("generated_on"))
    return cache.join(F.broadcast(best), "generated_on")  # one row


def incomplete_dates(cache: DataFrame, days: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Days of ``days(day)`` for which any of the models is missing, and how many are."""
    asked = days.select("day", F.explode(F.array(*map(F.lit, models))).alias("model"))
    have = cache.select(F.col("forecast_date").alias("day"), "model").distinct()
    return asked.join(have, ["day", "model"], "left_anti").groupBy(text_date(F.col("day")).alias("day")).agg(F.count(F.lit(1)).alias("missing_models"))


def projection_total(forecast: DataFrame, days: int = 7) -> DataFrame:
    """The sum of the first days of a forecast (day, forecast)."""
    return forecast.orderBy("day").limit(days).agg(F.round(F.sum("forecast"), 2).alias("projected"), F.count(F.lit(1)).alias("days"))


def is_stale(trained_through: Column, now: Column) -> Column:
    """Whether a model lacks the last complete business day; never before 05:00, while that day is open."""
    open_day = F.to_date(now - F.expr("INTERVAL 5 HOURS"))
    return (F.hour(now) >= 5) & (trained_through < F.date_sub(open_day, 1))

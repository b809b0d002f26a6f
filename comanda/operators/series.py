"""Time-series features over daily tables: lags, rolling frames, fills, averages and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from comanda.functions.dates import text_date, week_ending_sunday
from comanda.operators.insights import calendar, dense_days
from comanda.sources.adapter import Shop


def one_series() -> WindowSpec:
    """One series of one shop: a row a day, sorted in one task by design."""
    return Window.partitionBy(F.lit(1)).orderBy("day")


def _avg(c: str, lo: int, hi: int) -> Column:
    return F.round(F.avg(c).over(one_series().rowsBetween(lo, hi)), 4)


def revenue_features(shop: Shop, start: str, end: str) -> DataFrame:
    """lag 1 and 7, shifted rolling means of 7 and 14 days, and the trend of two 3-day means."""
    days = dense_days(shop, start, end)
    return days.select(
        text_date(F.col("day")).alias("day"), F.round("revenue", 2).alias("revenue"), F.round(F.lag("revenue", 1).over(one_series()), 2).alias("lag1"), F.round(F.lag("revenue", 7).over(one_series()), 2).alias("lag7"),
        _avg("revenue", -7, -1).alias("mean7"), _avg("revenue", -14, -1).alias("mean14"), F.round(F.avg("revenue").over(one_series().rowsBetween(-3, -1)) - F.avg("revenue").over(one_series().rowsBetween(-6, -4)), 4).alias("trend"),
    )


def item_features(shop: Shop, start: str, end: str) -> DataFrame:
    """The item panel: every day since an item's first sale, zero-filled, with its lags and means."""
    sales = shop.items.join(shop.success.filter(F.col("business_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("order_id", "business_date"), "order_id").groupBy("menu_item_id", F.col("business_date").alias("day")).agg(F.sum("quantity").alias("q"))
    seen = sales.groupBy("menu_item_id").agg(F.min("day").alias("first"))
    grid = seen.select("menu_item_id", F.explode(F.sequence(F.col("first"), F.lit(end).cast("date"))).alias("day"), "first")
    panel = grid.join(sales, ["menu_item_id", "day"], "left").withColumn("q", F.coalesce("q", F.lit(0.0)))
    by_item = Window.partitionBy("menu_item_id").orderBy("day")
    return panel.select("menu_item_id", text_date(F.col("day")).alias("day"), "q", F.datediff("day", "first").alias("days_since_launch"), F.lag("q", 1).over(by_item).alias("lag1"), F.lag("q", 7).over(by_item).alias("lag7"), F.round(F.avg("q").over(by_item.rowsBetween(-7, -1)), 4).alias("mean7"))


def store_totals(shop: Shop, start: str, end: str) -> DataFrame:
    """An item's quantity and the rest of the shop's in the seven days before, never under 0."""
    panel = item_features(shop, start, end).select("menu_item_id", "day", "q")
    daily = panel.groupBy("day").agg(F.sum("q").alias("all_q"))
    total = daily.select("day", F.sum("all_q").over(one_series().rowsBetween(-7, -1)).alias("all7"))
    own = F.sum("q").over(Window.partitionBy("menu_item_id").orderBy("day").rowsBetween(-7, -1))
    return panel.withColumn("own7", own).join(total, "day").select("menu_item_id", "day", "q", F.greatest(F.lit(0.0), F.coalesce("all7", F.lit(0.0)) - F.coalesce("own7", F.lit(0.0))).alias("others7"))


def revenue_with_weather(shop: Shop, start: str, end: str) -> DataFrame:
    """Dense days with the temperature carried forward, then backward."""
    rows = dense_days(shop, start, end).join(shop.weather.select("day", "temp_max"), "day", "left")
    forward = F.last("temp_max", ignorenulls=True).over(one_series().rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first("temp_max", ignorenulls=True).over(one_series().rowsBetween(0, Window.unboundedFollowing))
    return rows.select(text_date(F.col("day")).alias("day"), F.round("revenue", 2).alias("revenue"), "num_orders", F.coalesce(forward, backward).alias("temp_max"))


def cumulative_revenue(shop: Shop, start: str, end: str) -> DataFrame:
    days = dense_days(shop, start, end)
    return days.select(text_date(F.col("day")).alias("day"), F.round(F.sum("revenue").over(one_series().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cumulative"))


def selected_moving_average(shop: Shop, start: str, end: str, weekdays: tuple[int, ...]) -> DataFrame:
    """Mean over the selected weekdays of the last seven calendar days (a RANGE frame)."""
    days = dense_days(shop, start, end).filter(F.weekday("day").isin(*weekdays)).withColumn("n", F.datediff("day", F.lit("1970-01-01").cast("date")))
    seven = Window.partitionBy(F.lit(1)).orderBy("n").rangeBetween(-6, 0)
    return days.select(text_date(F.col("day")).alias("day"), F.round(F.avg("revenue").over(seven), 2).alias("moving_average"), F.count(F.lit(1)).over(seven).alias("days"))


def weekday_forecast(shop: Shop, start: str, end: str, horizon: int = 7) -> DataFrame:
    """Each coming day as the mean of the days 7, 14, 21 and 28 before it."""
    days = dense_days(shop, start, end).select("day", "revenue")
    coming = shop.spark.range(1, horizon + 1).select(F.date_add(F.lit(end).cast("date"), F.col("id").cast("int")).alias("target"))
    asked = coming.select("target", F.explode(F.array(*map(F.lit, (7, 14, 21, 28)))).alias("back")).withColumn("day", F.date_sub("target", F.col("back")))
    return asked.join(days, "day").groupBy(text_date(F.col("target")).alias("day")).agg(F.round(F.avg("revenue"), 2).alias("forecast"), F.count(F.lit(1)).alias("days"))


def new_customer_average(shop: Shop) -> DataFrame:
    """Seven-row average of new customers; the first six rows stay as they are."""
    first = shop.verified_orders.groupBy("customer_id").agg(F.min("business_date").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    seven = F.round(F.sum("n").over(one_series().rowsBetween(-6, 0)) / 7)
    return first.select(text_date(F.col("day")).alias("day"), F.col("n").alias("new_customers"), F.when(F.row_number().over(one_series()) <= 6, F.col("n").cast("double")).otherwise(seven).alias("average"))


def weekly_buckets(shop: Shop, start: str, end: str) -> DataFrame:
    """Weeks that end on Sunday: revenue, average a day and average order value."""
    weeks = dense_days(shop, start, end).groupBy(text_date(week_ending_sunday(F.col("day"))).alias("week")).agg(F.sum("revenue").alias("r"), F.sum("num_orders").alias("n"), F.count(F.lit(1)).alias("days"))
    return weeks.select("week", F.round("r", 2).alias("revenue"), F.col("n").alias("num_orders"), F.round(F.col("r") / F.col("days"), 2).alias("avg_revenue"), F.round(F.col("r") / F.nullif("n", F.lit(0)), 2).alias("avg_order_value"))


def missing_days(shop: Shop, start: str, end: str, kinds: int = 5) -> DataFrame:
    """Days of the range without sales from all sources."""
    have = shop.success.groupBy(F.col("business_date").alias("day")).agg(F.countDistinct("order_from").alias("kinds")).filter(F.col("kinds") >= kinds)
    return calendar(shop, start, end).join(have, "day", "left_anti").select(text_date(F.col("day")).alias("day"))


def forecast_or_backtest(shop: Shop, start: str, end: str, today: str) -> DataFrame:
    """Actual days before today, weekday forecasts from today on, as one series."""
    past = dense_days(shop, start, end).filter(F.col("day") < F.lit(today).cast("date")).select(text_date(F.col("day")).alias("day"), F.round("revenue", 2).alias("value"), F.lit("backtest").alias("kind"))
    coming = weekday_forecast(shop, start, end).select("day", F.col("forecast").alias("value"), F.lit("forecast").alias("kind"))
    return past.unionByName(coming.filter(F.col("day") >= today))

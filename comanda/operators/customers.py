"""Loyalty metrics of verified customers, each from one pass over their orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.functions.dates import money, percent, text_date
from comanda.sources.adapter import Shop

NEW_AFTER, REPEAT_WITHIN = 365, 60


def _in(start: str, end: str) -> Column:
    return F.col("business_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def window_activity(shop: Shop, start: str, end: str) -> DataFrame:
    rows = shop.verified_orders.filter(_in(start, end)).groupBy("customer_id")
    return rows.agg(F.count(F.lit(1)).alias("num_orders"), F.coalesce(F.sum(F.col("total").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("spend"), text_date(F.min("business_date")).alias("first_day"), text_date(F.max("business_date")).alias("last_day"), F.coalesce(F.min("name"), F.concat(F.lit("Customer "), F.first("customer_id").cast("string"))).alias("name"))


def _counts(shop: Shop, evaluation: tuple[str, str], lookback: tuple[str, str]) -> DataFrame:
    rows = shop.verified_orders.groupBy("customer_id")
    return rows.agg(F.count(F.when(_in(*evaluation), 1)).alias("n"), F.count(F.when(_in(*lookback), 1)).alias("before"), F.sum(F.when(_in(*evaluation), F.col("total"))).alias("spend"), F.min("name").alias("name"))


def _repeat_threshold(min_orders: int) -> None:
    if min_orders < 2:
        raise ValueError("a repeat is at least two orders")


def return_rate(shop: Shop, evaluation: tuple[str, str], lookback: tuple[str, str], min_orders: int = 2) -> DataFrame:
    _repeat_threshold(min_orders)
    active = _counts(shop, evaluation, lookback).filter("n > 0")
    back = F.count(F.when((F.col("n") >= min_orders) | (F.col("before") > 0), 1))
    return active.agg(F.count(F.lit(1)).alias("customers"), back.alias("returning"), percent(back, F.count(F.lit(1))).alias("rate"))


def retention_rate(shop: Shop, evaluation: tuple[str, str], lookback: tuple[str, str], min_orders: int = 1) -> DataFrame:
    cohort = _counts(shop, evaluation, lookback).filter("before > 0")
    kept = F.count(F.when(F.col("n") >= min_orders, 1))
    return cohort.agg(F.count(F.lit(1)).alias("customers"), kept.alias("retained"), percent(kept, F.count(F.lit(1))).alias("rate"))


def repeat_rate(shop: Shop, evaluation: tuple[str, str], min_orders: int = 2) -> DataFrame:
    _repeat_threshold(min_orders)
    active = _counts(shop, evaluation, evaluation).filter("n > 0")
    again = F.count(F.when(F.col("n") >= min_orders, 1))
    return active.agg(F.count(F.lit(1)).alias("customers"), again.alias("repeating"), percent(again, F.count(F.lit(1))).alias("rate"))


def return_analysis(shop: Shop, evaluation: tuple[str, str], lookback: tuple[str, str], min_orders: int = 2) -> DataFrame:
    """A row for each active customer with its flag and the reason of it."""
    _repeat_threshold(min_orders)
    active = _counts(shop, evaluation, lookback).filter("n > 0")
    enough, seen = F.col("n") >= min_orders, F.col("before") > 0
    reason = F.when(enough & seen, "both").when(enough, "orders in period").when(seen, "earlier order").otherwise("none")
    return active.select("customer_id", "name", F.col("n").alias("num_orders"), F.col("before").alias("lookback_orders"), money(F.col("spend")).alias("spend"), (enough | seen).alias("is_returning"), reason.alias("reason"))


def affinity(shop: Shop, start: str, end: str) -> DataFrame:
    """Segment of every customer active in the period, by the gap to the last order before it."""
    day = F.col("business_date")
    rows = shop.verified_orders.groupBy("customer_id").agg(F.count(F.when(_in(start, end), 1)).alias("n"), F.max(F.when(day < F.lit(start).cast("date"), day)).alias("last"))
    gap = F.datediff(F.lit(start).cast("date"), F.col("last"))
    segment = F.when(gap.isNull() | (gap >= NEW_AFTER), "New").when(gap <= REPEAT_WITHIN, "Repeat").otherwise("Lapsed")
    return rows.filter("n > 0").select("customer_id", F.col("n").alias("num_orders"), gap.alias("gap_days"), segment.alias("segment"))


def affinity_breakup(shop: Shop, start: str, end: str) -> DataFrame:
    return affinity(shop, start, end).groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("num_orders").alias("num_orders"))


def ranked_orders(shop: Shop) -> DataFrame:
    """Each order's rank in its customer's full history."""
    return shop.verified_orders.withColumn("order_rank", F.row_number().over(Window.partitionBy("customer_id").orderBy("created_on", "order_id")))


def monthly_loyalty(shop: Shop) -> DataFrame:
    again = F.col("order_rank") > 1
    rows = ranked_orders(shop).groupBy(F.date_format("business_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.count(F.when(again, 1)).alias("repeat_orders"), F.countDistinct("customer_id").alias("customers"),
        F.countDistinct(F.when(again, F.col("customer_id"))).alias("repeat_customers"), F.sum("total").alias("r"), F.sum(F.when(again, F.col("total"))).alias("rr"),
    )
    return rows.select("month", "orders", "repeat_orders", "customers", "repeat_customers", money(F.col("r")).alias("revenue"), money(F.col("rr")).alias("repeat_revenue"), percent(F.col("repeat_orders"), F.col("orders")).alias("order_repeat_rate"), percent(F.col("repeat_customers"), F.col("customers")).alias("customer_repeat_rate"), percent(F.round(F.coalesce("rr", F.lit(0.0)), 2), F.round("r", 2)).alias("revenue_repeat_rate"))


def trailing_reorder(shop: Shop, months: int = 3) -> DataFrame:
    last = monthly_loyalty(shop).orderBy(F.desc("month")).limit(months)
    return last.agg(F.round(F.avg("orders"), 2).alias("avg_orders"), F.round(F.avg("repeat_orders"), 2).alias("avg_repeat_orders"), percent(F.sum("repeat_orders"), F.sum("orders")).alias("reorder_rate"))


def monthly_retention(shop: Shop, first_month: str, months: int, lookback_days: int = 60) -> DataFrame:
    """Retention of every month from one job: months meet the customers' days in a range."""
    days = shop.verified_orders.select("customer_id", "business_date").distinct()
    spans = shop.spark.range(months).select(F.add_months(F.lit(first_month).cast("date"), F.col("id").cast("int")).alias("start")).withColumn("end", F.last_day("start"))
    met = days.join(F.broadcast(spans), (F.col("business_date") <= F.col("end")) & (F.col("business_date") >= F.date_sub("start", lookback_days)))  # a row a month
    inside = F.col("business_date") >= F.col("start")
    each = met.groupBy("start", "customer_id").agg(F.max(inside).alias("now"), F.max(~inside).alias("before")).filter("before")
    return each.groupBy(F.date_format("start", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("cohort"), F.count(F.when(F.col("now"), 1)).alias("retained"), percent(F.count(F.when(F.col("now"), 1)), F.count(F.lit(1))).alias("rate"))


def _bucket(grain: str, day: Column) -> Column:
    return text_date({"day": day, "week": F.to_date(F.date_trunc("week", day)), "month": F.to_date(F.date_trunc("month", day))}[grain])


def reorder_trend_orders(shop: Shop, grain: str) -> DataFrame:
    """Share of orders with an earlier one, from the first order of each customer (no self-join)."""
    first = Window.partitionBy("customer_id")
    rows = shop.verified_orders.withColumn("again", F.col("created_on") > F.min("created_on").over(first))
    return rows.groupBy(_bucket(grain, F.col("business_date")).alias("bucket")).agg(F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("again"), 1)).alias("reorders"), percent(F.count(F.when(F.col("again"), 1)), F.count(F.lit(1))).alias("rate"))


def reorder_trend_customers(shop: Shop, grain: str) -> DataFrame:
    """Share of a bucket's customers whose first order lies before the bucket."""
    rows = shop.verified_orders.withColumn("bucket", _bucket(grain, F.col("business_date"))).withColumn("first", F.min("business_date").over(Window.partitionBy("customer_id")))
    each = rows.select("bucket", "customer_id", (F.col("first").cast("string") < F.col("bucket")).alias("again")).distinct()
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("again"), 1)).alias("returning"), percent(F.count(F.when(F.col("again"), 1)), F.count(F.lit(1))).alias("rate"))


def quick_view(shop: Shop, evaluation: tuple[str, str], lookback: tuple[str, str]) -> DataFrame:
    """The headline rates from one aggregation per customer."""
    each = _counts(shop, evaluation, lookback)
    n, before = F.col("n"), F.col("before")
    count = lambda cond: F.count(F.when(cond, 1))
    return each.agg(
        F.count(F.lit(1)).alias("customers"), count(n > 0).alias("active"), count((n > 0) & ((n >= 2) | (before > 0))).alias("returned"), count((before > 0) & (n > 0)).alias("retained"), count(n >= 2).alias("repeating"),
        percent(count((n > 0) & ((n >= 2) | (before > 0))), count(n > 0)).alias("return_rate"), percent(count((before > 0) & (n > 0)), count(before > 0)).alias("retention_rate"), percent(count(n >= 2), count(n > 0)).alias("repeat_rate"),
    )


def recomputed_totals(shop: Shop) -> DataFrame:
    """Counters of every customer over all statuses."""
    return shop.orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("total_orders"), money(F.sum("total")).alias("total_spent"), text_date(F.min("business_date")).alias("first_order"), text_date(F.max("business_date")).alias("last_order"))

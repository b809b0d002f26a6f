"""Sales reports: key figures, trends, mixes, hourly profiles and top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comanda.functions.dates import business_date, day_range, money, sunday_first, text_date, week_of_year
from comanda.sources.adapter import Shop

SOURCES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def kpis(shop: Shop, today: str) -> DataFrame:
    """One scan with conditional aggregates, and one for the verified customers."""
    rows = shop.success.join(shop.customers.select("customer_id", "is_verified"), "customer_id", "left")
    own = F.col("is_verified")
    return rows.agg(
        F.count(F.lit(1)).alias("total_orders"), money(F.sum("total")).alias("total_revenue"), F.round(F.avg("total"), 2).alias("avg_order_value"),
        F.count(F.when(own, 1)).alias("verified_orders"), F.countDistinct(F.when(own, F.col("customer_id"))).alias("verified_customers"),
        money(F.sum(F.when(F.col("business_date") == F.lit(today).cast("date"), F.col("total")))).alias("today_revenue"),
    )


def daily_sales(shop: Shop) -> DataFrame:
    by_source = [money(F.sum(F.when(F.col("order_from") == s, F.col("total")))).alias(f"revenue_{k}") for k, s in enumerate(SOURCES, 1)]
    days = shop.success.groupBy("business_date").agg(money(F.sum("total")).alias("revenue"), F.round(F.sum(F.col("total") - F.col("tax_total")), 4).alias("net_revenue"), F.round(F.sum("tax_total"), 4).alias("tax"), F.count(F.lit(1)).alias("num_orders"), *by_source)
    return days.select(text_date(F.col("business_date")).alias("order_date"), "revenue", "net_revenue", "tax", "num_orders", *[f"revenue_{k}" for k in range(1, len(SOURCES) + 1)])


def category_trend(shop: Shop) -> DataFrame:
    rows = shop.items.join(shop.success.select("order_id", "business_date"), "order_id").join(shop.menu.select("menu_item_id", "type"), "menu_item_id")
    return rows.groupBy(text_date(F.col("business_date")).alias("order_date"), F.col("type").alias("category")).agg(money(F.sum("total_price")).alias("revenue"), F.sum("quantity").alias("quantity"))


def _sold_of_success(shop: Shop, distinct_addons: bool) -> DataFrame:
    """Item and add-on lines of successful orders. Item lines have a key of their own, so DISTINCT
    would change nothing; equal add-ons of one order count once where asked."""
    columns = ["order_id", "menu_item_id", "quantity", "unit_price", "total_price"]
    addons = shop.addons.select(*columns)
    lines = shop.items.select(*columns).unionByName(addons.dropDuplicates() if distinct_addons else addons)
    return lines.join(shop.success.select("order_id"), "order_id", "left_semi")


def top_items(shop: Shop, k: int = 10) -> DataFrame:
    sold = _sold_of_success(shop, True).groupBy("menu_item_id").agg(F.sum("quantity").alias("q"), F.sum("total_price").alias("r"))
    share = F.round(F.lit(100.0) * F.col("r") / F.col("whole"), 4)
    shared = sold.crossJoin(F.broadcast(sold.agg(F.sum("r").alias("whole")))).withColumn("share", share)  # with one row
    rows = shop.menu.filter("is_active").select("menu_item_id", "name").join(shared, "menu_item_id", "left")
    rows = rows.select("menu_item_id", "name", F.coalesce("q", F.lit(0.0)).alias("total_sold"), F.round("r", 2).alias("item_revenue"), F.col("share").alias("revenue_share"))
    return rows.orderBy(F.desc("total_sold"), "menu_item_id").limit(k)


def revenue_by_category(shop: Shop) -> DataFrame:
    rows = _sold_of_success(shop, False).join(shop.menu.select("menu_item_id", "type"), "menu_item_id").filter("type is not null and type <> ''")
    return rows.groupBy(F.col("type").alias("category")).agg(money(F.sum("total_price")).alias("revenue"), F.sum("quantity").alias("quantity"))


def category_shares(shop: Shop) -> DataFrame:
    rows = _sold_of_success(shop, False).join(shop.menu.select("menu_item_id", "type"), "menu_item_id")
    sums = rows.groupBy(F.col("type").alias("category")).agg(F.sum("total_price").alias("r"))
    return sums.select("category", F.round("r", 2).alias("revenue"), F.round(F.lit(100.0) * F.col("r") / F.sum("r").over(Window.partitionBy(F.lit(1))), 4).alias("share"))  # a row a category


def hourly_revenue(shop: Shop, weekdays: tuple[int, ...] = ()) -> DataFrame:
    """Revenue by clock hour and its average over the business days of the selection."""
    rows = shop.success
    if weekdays:
        rows = rows.filter(sunday_first(F.col("business_date")).isin(*weekdays))
    days = rows.agg(F.countDistinct("business_date").alias("days"))
    hours = rows.groupBy(F.hour("created_on").alias("hour")).agg(F.sum("total").alias("r"), F.count(F.lit(1)).alias("num_orders"))
    out = hours.join(F.broadcast(days))  # one row
    return out.select("hour", money(F.col("r")).alias("revenue"), "num_orders", F.round(F.col("r") / F.nullif("days", F.lit(0)), 2).alias("avg_revenue"), F.when(F.col("hour") >= 5, F.col("hour")).otherwise(F.col("hour") + 24).alias("business_hour"))


def hourly_revenue_of(shop: Shop, day: str) -> DataFrame:
    """With the running total over the business day."""
    hours = shop.success.filter(day_range(F.col("created_on"), day, day)).groupBy(F.hour("created_on").alias("hour")).agg(F.sum("total").alias("r"), F.count(F.lit(1)).alias("num_orders"))
    hours = hours.withColumn("business_hour", F.when(F.col("hour") >= 5, F.col("hour")).otherwise(F.col("hour") + 24))
    upto = Window.partitionBy(F.lit(1)).orderBy("business_hour").rowsBetween(Window.unboundedPreceding, 0)  # at most 24 rows
    return hours.select("hour", "business_hour", money(F.col("r")).alias("revenue"), "num_orders", money(F.sum("r").over(upto)).alias("running_revenue"))


def order_sources(shop: Shop) -> DataFrame:
    everything = shop.success.groupBy("order_from").agg(F.count(F.lit(1)).alias("num_orders"), F.sum("total").alias("r"))
    share = F.round(F.lit(100.0) * F.col("r") / F.sum("r").over(Window.partitionBy(F.lit(1))), 2)  # a row a source
    return everything.select("order_from", "num_orders", money(F.col("r")).alias("revenue"), share.alias("revenue_share"))


def calendar(shop: Shop, start: str, end: str) -> DataFrame:
    return shop.spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))


def dense_days(shop: Shop, start: str, end: str) -> DataFrame:
    """Every day of the range with its sales, 0 where there are none."""
    sales = shop.success.filter(day_range(F.col("created_on"), start, end)).groupBy(F.col("business_date").alias("day")).agg(F.sum("total").alias("r"), F.count(F.lit(1)).alias("n"))
    return calendar(shop, start, end).join(sales, "day", "left").select("day", F.coalesce("r", F.lit(0.0)).alias("revenue"), F.coalesce("n", F.lit(0)).alias("num_orders"))


def revenue_by_weekday(shop: Shop, start: str, end: str) -> DataFrame:
    days = dense_days(shop, start, end)
    return days.groupBy(F.weekday("day").alias("weekday")).agg(F.round(F.avg("revenue"), 2).alias("avg_revenue"), F.count(F.lit(1)).alias("days"))


def brand_awareness(shop: Shop, grain: str) -> DataFrame:
    """New verified customers by the bucket of their first order: day, week (%Y-%W) or month."""
    first = shop.verified_orders.groupBy("customer_id").agg(business_date(F.min("created_on")).alias("day"))
    bucket = {"day": text_date(F.col("day")), "week": F.concat_ws("-", F.year("day").cast("string"), week_of_year(F.col("day"))), "month": F.date_format("day", "yyyy-MM")}[grain]
    return first.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("new_customers"))


def category_pivot(shop: Shop) -> DataFrame:
    """A row a month and a column for each of the fixed categories."""
    kinds = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    rows = shop.items.join(shop.success.select("order_id", F.date_format("business_date", "yyyy-MM").alias("month")), "order_id").join(shop.menu.select("menu_item_id", "type"), "menu_item_id")
    wide = rows.groupBy("month").pivot("type", list(kinds)).agg(F.sum("total_price"))
    return wide.select("month", *[money(F.col(k)).alias(k.lower()) for k in kinds])


def top_customers(shop: Shop, k: int = 50) -> DataFrame:
    """By spend, each with the item of most quantity (ties by name)."""
    orders = shop.verified_orders.select("order_id", "customer_id", "name", "total")
    spend = orders.groupBy("customer_id", "name").agg(F.count(F.lit(1)).alias("num_orders"), F.sum("total").alias("spend"))
    top = spend.orderBy(F.desc("spend"), "customer_id").limit(k)
    lines = shop.sold.select("order_id", "menu_item_id", "quantity").join(orders.select("order_id", "customer_id"), "order_id").join(F.broadcast(top.select("customer_id")), "customer_id")  # k rows
    liked = lines.join(shop.menu.select("menu_item_id", F.col("name").alias("item")), "menu_item_id").groupBy("customer_id", "item").agg(F.sum("quantity").alias("q"))
    best = liked.withColumn("r", F.row_number().over(Window.partitionBy("customer_id").orderBy(F.desc("q"), "item"))).filter("r = 1")
    return top.join(best.select("customer_id", F.col("item").alias("favourite_item"), F.col("q").alias("favourite_quantity")), "customer_id", "left").withColumn("spend", F.round("spend", 2))


def popular_queries(shop: Shop, limit: int = 20) -> DataFrame:
    """Whole texts of users by how often and how lately they were asked; conversations have no
    time, so the latest is that of the greatest conv_id."""
    asked = shop.raw("conversations").filter((F.col("role") == "user") & (F.col("text") != ""))
    return asked.groupBy(F.col("text").alias("user_query")).agg(F.count(F.lit(1)).alias("freq"), F.max("conv_id").alias("last_used")).orderBy(F.desc("freq"), F.desc("last_used"), "user_query").limit(limit)

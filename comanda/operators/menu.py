"""Menu statistics, units and the day's operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.functions.dates import day_range, money, percent, sunday_first, text_date
from comanda.functions.text import contains_ci
from comanda.operators.insights import SOURCES
from comanda.session import spread
from comanda.sources.adapter import Shop


KINDS = ("item", "addon")


def menu_stats(shop: Shop, start: str | None = None, end: str | None = None, weekdays: tuple[int, ...] = (), search: str = "", kind: str = "") -> DataFrame:
    """Per item: sales as item and add-on, units, customers, and what was bought again.

    A line is a reorder unless it is the customer's first of the item in its branch (items, add-ons)
    of the full history; the filters (business days, weekdays with Sunday 0, name, type) then choose
    lines. Lines meet orders once, replays go within that partitioning, and one aggregation per
    customer and item holds what the first lines were, so nothing is ranked and nothing counted apart.
    """
    orders = shop.success.select("order_id", "customer_id", "created_on", "business_date")
    lines = spread(shop.sold.select("order_id", "menu_item_id", "quantity", "unit_price", "kind"), shop.n_lines, "order_id").join(orders, "order_id")
    lines = lines.dropDuplicates(["order_id", "menu_item_id", "quantity", "unit_price", "kind"])
    lines = spread(lines, shop.n_lines, "menu_item_id", "customer_id")  # most pairs have one line

    def chosen(day: Column) -> Column:
        ok = day.isNotNull()
        if start:
            ok = ok & (day >= F.lit(start).cast("date"))
        if end:
            ok = ok & (day <= F.lit(end).cast("date"))
        return ok & sunday_first(day).isin(*weekdays) if weekdays else ok

    ok, revenue = chosen(F.col("business_date")), F.col("quantity") * F.col("unit_price")
    line = F.struct("created_on", "order_id", "quantity", "unit_price", "business_date")
    own = lambda k, x: F.when(F.col("kind") == k, x)
    each = lines.groupBy("menu_item_id", "customer_id").agg(
        *[F.min(own(k, line)).alias(f"first_{k}") for k in KINDS], *[F.count(own(k, F.when(ok, 1))).alias(f"n_{k}") for k in KINDS],
        *[F.sum(own(k, F.when(ok, F.col("quantity")))).alias(f"q_{k}") for k in KINDS], F.sum(F.when(ok, revenue)).alias("revenue"),
    )
    first = lambda k, x: F.when(chosen(F.col(f"first_{k}.business_date")), x).otherwise(0)
    first_q = [first(k, F.col(f"first_{k}.quantity")) for k in KINDS]
    first_revenue = [first(k, F.col(f"first_{k}.quantity") * F.col(f"first_{k}.unit_price")) for k in KINDS]
    again = F.lit(False)
    for k in KINDS:
        again = again | (F.col(f"n_{k}") - first(k, F.lit(1)) > 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    stats = each.filter("n_item + n_addon > 0").groupBy("menu_item_id").agg(
        F.sum("q_item").alias("i"), F.sum("q_addon").alias("a"), F.sum("revenue").alias("r"), F.sum(zero("q_item") + zero("q_addon") - sum(first_q, F.lit(0.0))).alias("reordered"), F.sum(zero("revenue") - sum(first_revenue, F.lit(0.0))).alias("rr"),
        F.count(F.lit(1)).alias("customers"), F.count(F.when(again, 1)).alias("repeat_customers"),
    )
    joined = shop.menu.join(stats, "menu_item_id")
    if search:
        joined = joined.filter(contains_ci(F.col("name"), search))
    if kind:
        joined = joined.filter(F.col("type") == kind)
    total = zero("i") + zero("a")
    unit = lambda u: F.when(F.upper("unit").isin(*u), total * F.col("unit_value")).otherwise(0.0)
    return joined.select(
        "menu_item_id", "name", "type", zero("a").alias("as_addon"), zero("i").alias("as_item"), total.alias("total_sold"), money(F.col("r")).alias("revenue"), unit(("G", "GMS")).alias("grams"), unit(("ML",)).alias("millilitres"), unit(("COUNT",)).alias("pieces"),
        F.round("reordered", 3).alias("reorder_quantity"), "repeat_customers", "customers", percent(F.col("repeat_customers"), F.col("customers")).alias("reorder_rate"), percent(F.round("rr", 2), F.round("r", 2)).alias("repeat_revenue_rate"),
    )


def menu_summary(shop: Shop, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every menu item with what it sold as item and add-on, replayed lines once; 0 where nothing sold."""
    days = F.lit(True)
    if start:
        days = days & (F.col("business_date") >= F.lit(start).cast("date"))
    if end:
        days = days & (F.col("business_date") <= F.lit(end).cast("date"))
    lines = shop.sold.join(shop.success.filter(days).select("order_id"), "order_id").dropDuplicates(["order_id", "menu_item_id", "quantity", "unit_price", "kind"])
    sold = lines.groupBy("menu_item_id").agg(F.sum(F.when(F.col("kind") == "item", F.col("quantity"))).alias("i"), F.sum(F.when(F.col("kind") == "addon", F.col("quantity"))).alias("a"), F.sum(F.col("quantity") * F.col("unit_price")).alias("r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return shop.menu.join(sold, "menu_item_id", "left").select("menu_item_id", "name", "type", "is_active", zero("i").alias("as_item"), zero("a").alias("as_addon"), (zero("i") + zero("a")).alias("total_sold"), money(F.col("r")).alias("revenue"))


def mixed_units(shop: Shop) -> DataFrame:
    """Item names sold both by count and by weight."""
    rows = shop.menu.groupBy("name").agg(F.max(F.col("unit") == "COUNT").alias("by_count"), F.max(F.col("unit") != "COUNT").alias("by_weight"))
    return rows.filter("by_count and by_weight").select("name")


def primary_units(shop: Shop) -> DataFrame:
    return shop.menu.groupBy("name").agg(F.when(F.max(F.upper("unit") == "COUNT"), "units").otherwise("g").alias("unit"))


def unit_factor(unit: Column) -> Column:
    """Grams (or pieces, or millilitres) of one unit; unknown and missing units are milligrams."""
    u = F.upper(F.trim(unit))
    return F.when(u.isin("COUNT", "ML", "G", "GMS"), 1.0).when(u == "KG", 1000.0).otherwise(0.001)


def item_volume_daily(shop: Shop) -> DataFrame:
    factor = unit_factor(F.col("unit"))
    rows = shop.items.join(shop.success.select("order_id", "business_date"), "order_id").join(shop.menu.select("menu_item_id", "unit", "unit_value"), "menu_item_id")
    return rows.groupBy(text_date(F.col("business_date")).alias("day"), "menu_item_id").agg(F.round(F.sum(F.col("quantity") * F.col("unit_value") * factor), 3).alias("volume"), F.round(F.avg("unit_price"), 6).alias("avg_price"))


def item_daily_weather(shop: Shop) -> DataFrame:
    """Daily quantity per item with the price of its first line and the day's weather."""
    rows = shop.items.join(shop.success.select("order_id", "business_date"), "order_id").groupBy("business_date", "menu_item_id")
    daily = rows.agg(F.sum("quantity").alias("quantity_sold"), F.min_by("unit_price", F.struct("order_id", "line_no", "unit_price")).alias("unit_price"))
    weather = shop.weather.select(F.col("day").alias("business_date"), "temp_max")
    return daily.join(weather, "business_date", "left").select(text_date(F.col("business_date")).alias("day"), "menu_item_id", "quantity_sold", "unit_price", "temp_max")


def recalculated_counters(shop: Shop) -> DataFrame:
    rows = shop.sold.join(shop.success.select("order_id"), "order_id", "left_semi").groupBy("menu_item_id")
    return rows.agg(F.sum("quantity").alias("total_sold"), money(F.sum("total_price")).alias("total_revenue"), F.sum(F.when(F.col("kind") == "item", F.col("quantity")).otherwise(0.0)).alias("sold_as_item"), F.sum(F.when(F.col("kind") == "addon", F.col("quantity")).otherwise(0.0)).alias("sold_as_addon"))


def menu_types(shop: Shop) -> DataFrame:
    return shop.menu.select("type").distinct()


def menu_matrix(shop: Shop) -> DataFrame:
    return shop.menu.filter("is_active").select("menu_item_id", "name", "type", "unit", F.col("unit_value").cast("long").alias("unit_value"), "price")


def _today(shop: Shop, day: str) -> DataFrame:
    return shop.success.filter(day_range(F.col("created_on"), day, day))


def _earlier_customers(shop: Shop, day: str) -> DataFrame:
    """Customers of the day who had ordered before it; only their orders are shuffled."""
    before = shop.success.filter(F.col("business_date") < F.lit(day).cast("date")).select("customer_id")
    return before.join(_today(shop, day).select("customer_id").distinct(), "customer_id", "left_semi").distinct()


def returning_customers(shop: Shop, day: str) -> DataFrame:
    now = _today(shop, day).select("customer_id").distinct()
    return now.join(_earlier_customers(shop, day), "customer_id", "left_semi").agg(F.count(F.lit(1)).alias("returning"))


def today_summary(shop: Shop, day: str) -> DataFrame:
    now = _today(shop, day).join(_earlier_customers(shop, day).withColumn("seen", F.lit(True)), "customer_id", "left")
    return now.agg(F.count(F.lit(1)).alias("orders"), money(F.sum("total")).alias("revenue"), F.countDistinct("customer_id").alias("customers"), F.countDistinct(F.when(F.col("seen"), F.col("customer_id"))).alias("returning"), *[c for k, v in enumerate(SOURCES, 1) for c in (money(F.sum(F.when(F.col("order_from") == v, F.col("total")))).alias(f"revenue_{k}"), F.count(F.when(F.col("order_from") == v, 1)).alias(f"orders_{k}"))])


def item_reorders(shop: Shop, day: str) -> DataFrame:
    """Verified customers of the day's items who had bought the same item before."""
    bought = shop.items.join(shop.verified_orders.select("order_id", "customer_id", "business_date"), "order_id").groupBy("customer_id", "menu_item_id")
    each = bought.agg(F.min("business_date").alias("first"), F.max(F.col("business_date") == F.lit(day).cast("date")).alias("now")).filter("now")
    return each.groupBy("menu_item_id").agg(F.count(F.lit(1)).alias("customers"), F.count(F.when(F.col("first") < F.lit(day).cast("date"), 1)).alias("reorder_customers"))


def today_items(shop: Shop, day: str) -> DataFrame:
    rows = shop.sold.join(_today(shop, day).select("order_id"), "order_id", "left_semi").join(shop.menu.select("menu_item_id", "name", "type"), "menu_item_id", "left")
    sold = rows.groupBy("menu_item_id", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("type", F.lit("other")).alias("category")).agg(F.sum("quantity").alias("quantity"), money(F.sum("total_price")).alias("revenue"))
    again = item_reorders(shop, day).select("menu_item_id", "reorder_customers")
    return sold.join(again, "menu_item_id", "left").withColumn("reorder_customers", F.coalesce("reorder_customers", F.lit(0)))


def today_customers(shop: Shop, day: str) -> DataFrame:
    """Order value, distinct items in order of name, whether the customer came before and is verified;
    verified ones first, then by value."""
    now = _today(shop, day)
    value = now.groupBy("customer_id").agg(money(F.sum("total")).alias("order_value"), F.count(F.lit(1)).alias("orders"))
    named = shop.items.join(now.select("order_id", "customer_id"), "order_id").join(shop.menu.select("menu_item_id", "name"), "menu_item_id")
    items = named.groupBy("customer_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("items"))
    seen = _earlier_customers(shop, day).withColumn("is_returning", F.lit(True))
    out = value.join(items, "customer_id", "left").join(seen, "customer_id", "left").join(shop.customers.select("customer_id", "is_verified"), "customer_id", "left")
    no = F.lit(False)
    out = out.select("customer_id", "order_value", "orders", F.coalesce("items", F.lit("")).alias("items"), F.coalesce("is_returning", no).alias("is_returning"), F.coalesce("is_verified", no).alias("is_verified"))
    return out.orderBy(F.desc("is_verified"), F.desc("order_value"), "customer_id")


def today_orders(shop: Shop, day: str) -> DataFrame:
    """Each order's items as ``name(quantity)``, marked -Repeat if the customer had them before."""
    now = _today(shop, day).select("order_id", "customer_id", "total")
    lines = shop.items.join(now, "order_id").groupBy("order_id", "customer_id", "total", "menu_item_id").agg(F.sum("quantity").cast("long").alias("q"))
    before = shop.items.join(shop.success.filter(F.col("business_date") < F.lit(day).cast("date")).select("order_id", "customer_id"), "order_id").join(now.select("customer_id").distinct(), "customer_id", "left_semi").select("customer_id", "menu_item_id").distinct().withColumn("had", F.lit("-Repeat"))
    text = F.concat("name", F.lit("("), F.col("q").cast("string"), F.lit(")"), F.coalesce("had", F.lit("")))
    rows = lines.join(before, ["customer_id", "menu_item_id"], "left").join(shop.menu.select("menu_item_id", "name"), "menu_item_id").withColumn("t", text)
    return rows.groupBy("order_id", "customer_id", F.round("total", 2).alias("total")).agg(F.array_join(F.array_sort(F.collect_list("t")), ", ").alias("items"))

"""Loyalty analyses of verified customers under one set of filters: sources, windows, thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.functions.dates import money, percent, text_date
from comanda.sources.adapter import Shop

RECENT_DAYS, DORMANT_DAYS = 60, 365
DEFAULT_MONTHS, MOST_MONTHS = 6, 24
#: An unverified person orders between these shares of a verified one's orders.
REPEAT_FACTORS = (0.8, 1.0)


def normalized_sources(sources: Sequence[str | None] | None) -> tuple[str, ...]:
    """Trimmed, without blanks and "all", each once in order; empty means every source."""
    stripped = (s.strip() for s in sources or () if s)
    return tuple(dict.fromkeys(s for s in stripped if s and s.lower() != "all"))


@dataclass(frozen=True)
class Filters:
    """Evaluation and lookback windows in business dates (None: open), threshold and sources."""

    start: str
    end: str
    back_start: str | None = None
    back_end: str | None = None
    back_days: int | None = None
    min_orders: int = 2
    sources: Sequence[str] | None = None

    def __post_init__(self):
        if self.start > self.end:
            raise ValueError("the evaluation starts after its end")
        if self.back_start and self.back_end and self.back_start > self.back_end:
            raise ValueError("the lookback starts after its end")
        if self.back_days is not None and self.back_days < 1:
            raise ValueError("a lookback has at least one day")
        if self.min_orders < 1:
            raise ValueError("at least one order is the least threshold")

    @property
    def lookback(self) -> tuple[str | None, str | None]:
        """The given window, else the days just before the evaluation, else all time."""
        if self.back_start or self.back_end or not self.back_days:
            return self.back_start, self.back_end
        last = date.fromisoformat(self.start) - timedelta(days=1)
        return (last - timedelta(days=self.back_days - 1)).isoformat(), last.isoformat()

    def repeated(self, what: str) -> Filters:
        """Self, if its threshold can tell a repeat."""
        if self.min_orders < 2:
            raise ValueError(f"{what} needs a threshold of at least two orders")
        return self


def _within(start: str | None, end: str | None) -> Column:
    day, inside = F.col("business_date"), F.lit(True)
    if start:
        inside = inside & (day >= F.lit(start).cast("date"))
    if end:
        inside = inside & (day <= F.lit(end).cast("date"))
    return inside


def metric_orders(shop: Shop, sources: Sequence[str] | None = None) -> DataFrame:
    """Success orders of verified customers, from the given sources."""
    wanted = normalized_sources(sources)
    return shop.verified_orders.filter(F.col("order_from").isin(*wanted)) if wanted else shop.verified_orders


def _activity(shop: Shop, f: Filters) -> DataFrame:
    """Per customer: n, spend, first and last day in the evaluation, and n_back in the lookback."""
    now, back = _within(f.start, f.end), _within(*f.lookback)
    day = F.col("business_date")
    rows = metric_orders(shop, f.sources).filter(now | back).groupBy("customer_id").agg(
        F.count(F.when(now, 1)).alias("n"), F.sum(F.when(now, F.col("total").cast("decimal(18,2)"))).alias("spend"), F.min(F.when(now, day)).alias("first"), F.max(F.when(now, day)).alias("last"),
        F.count(F.when(back, 1)).alias("n_back"), F.min("name").alias("name"),
    )
    name = F.coalesce("name", F.concat(F.lit("Customer "), F.col("customer_id").cast("string")))
    return rows.withColumn("name", name).withColumn("spend", F.coalesce("spend", F.lit(0)).cast("double"))


def orders_per_customer(shop: Shop, start: str | None, end: str | None, sources: Sequence[str] | None = None) -> DataFrame:
    return metric_orders(shop, sources).filter(_within(start, end)).groupBy("customer_id").agg(F.count(F.lit(1)).alias("num_orders"))


def _sorted(rows: DataFrame, flag: str) -> DataFrame:
    """By flag, orders and spend, greatest first, then name without case."""
    return rows.orderBy(F.desc(flag), F.desc("evaluation_orders"), F.desc("evaluation_spend"), F.lower("name"), "customer_id")


def _return_flags(f: Filters) -> tuple[Column, Column]:
    return F.col("n") >= f.min_orders, F.col("n_back") > 0


def return_analysis(shop: Shop, f: Filters) -> DataFrame:
    """A row for each customer of the evaluation: both reasons to count as returning, and the status."""
    again, seen = _return_flags(f.repeated("the return analysis"))
    reason = F.when(again & seen, "Repeat in evaluation window and ordered in lookback window").when(again, "Repeat in evaluation window").when(seen, "Ordered in lookback window").otherwise("First-time within selected windows")
    rows = _activity(shop, f).filter("n > 0").select(
        "customer_id", "name", F.col("n").alias("evaluation_orders"), F.col("n_back").alias("lookback_orders"), F.col("spend").alias("evaluation_spend"), text_date(F.col("first")).alias("first_day"), text_date(F.col("last")).alias("last_day"),
        again.cast("int").alias("by_repeat"), seen.cast("int").alias("by_lookback"), (again | seen).cast("int").alias("is_returning"), F.when(again | seen, "Returning").otherwise("New").alias("status"), reason.alias("reason"),
    )
    return _sorted(rows, "is_returning")


def return_summary(shop: Shop, f: Filters) -> DataFrame:
    again, seen = _return_flags(f.repeated("the return rate"))
    count = lambda c: F.count(F.when(c, 1))
    back = count(again | seen)
    return _activity(shop, f).filter("n > 0").agg(
        F.count(F.lit(1)).alias("customers"), back.alias("returning"), percent(back, F.count(F.lit(1))).alias("return_rate"), (F.count(F.lit(1)) - back).alias("new"),
        count(again).alias("by_repeat"), count(seen).alias("by_lookback"), count(again & seen).alias("by_both"),
    )


def retention_analysis(shop: Shop, f: Filters) -> DataFrame:
    """A row for each customer of the lookback cohort; a threshold of one order is allowed."""
    kept = F.col("n") >= f.min_orders
    reason = F.when(F.col("n") == 0, "No orders in evaluation window").when(kept, f"Met the {f.min_orders}+ order threshold").otherwise("Below the selected evaluation-window threshold")
    rows = _activity(shop, f).filter("n_back > 0").select(
        "customer_id", "name", F.col("n_back").alias("lookback_orders"), F.col("n").alias("evaluation_orders"), F.col("spend").alias("evaluation_spend"), text_date(F.col("first")).alias("first_day"), text_date(F.col("last")).alias("last_day"),
        kept.cast("int").alias("is_retained"), F.when(kept, "Retained").otherwise("Not Retained").alias("status"), reason.alias("reason"),
    )
    return _sorted(rows, "is_retained")


def retention_summary(shop: Shop, f: Filters) -> DataFrame:
    kept = F.count(F.when(F.col("n") >= f.min_orders, 1))
    return _activity(shop, f).filter("n_back > 0").agg(F.count(F.lit(1)).alias("cohort"), kept.alias("retained"), percent(kept, F.count(F.lit(1))).alias("retention_rate"), (F.count(F.lit(1)) - kept).alias("not_retained"))


def repeat_analysis(shop: Shop, f: Filters) -> DataFrame:
    again = F.col("n") >= f.repeated("the repeat analysis").min_orders
    rows = _activity(shop, f).filter("n > 0").select(
        "customer_id", "name", F.col("n").alias("evaluation_orders"), F.col("spend").alias("evaluation_spend"), text_date(F.col("first")).alias("first_day"), text_date(F.col("last")).alias("last_day"),
        again.cast("int").alias("is_repeat"), F.when(again, "Repeat").otherwise("Single Order").alias("status"), F.when(again, f"Met the {f.min_orders}+ order threshold").otherwise("Below the selected repeat-order threshold").alias("reason"),
    )
    return _sorted(rows, "is_repeat")


def repeat_summary(shop: Shop, f: Filters) -> DataFrame:
    again = F.count(F.when(F.col("n") >= f.repeated("the repeat rate").min_orders, 1))
    return _activity(shop, f).filter("n > 0").agg(F.count(F.lit(1)).alias("customers"), again.alias("repeating"), percent(again, F.count(F.lit(1))).alias("repeat_rate"), (F.count(F.lit(1)) - again).alias("single"))


def customer_estimate(verified_orders: Column, other_orders: Column, verified_customers: Column) -> tuple[Column, Column]:
    """(low, high) numbers of people behind all orders, rounded half to even.

    Without verified customers each unverified person is taken to order once.
    """
    low_factor, high_factor = REPEAT_FACTORS
    average = F.when(verified_customers > 0, F.when(verified_orders > 0, verified_orders / verified_customers).otherwise(1.0)).otherwise(1.0)
    people = lambda factor: F.bround(F.greatest(verified_customers, F.lit(0)) + other_orders / (F.lit(factor) * average), 0).cast("long")
    return people(high_factor), people(low_factor)


def estimated_customers(shop: Shop) -> DataFrame:
    """Orders, verified customers and the estimated range of all customers."""
    own = F.col("is_verified")
    rows = shop.success.join(shop.customers.select("customer_id", "is_verified"), "customer_id", "left")
    counts = rows.agg(F.count(F.lit(1)).alias("orders"), F.count(F.when(own, 1)).alias("verified_orders"), F.countDistinct(F.when(own, F.col("customer_id"))).alias("verified_customers"))
    low, high = customer_estimate(F.col("verified_orders"), F.col("orders") - F.col("verified_orders"), F.col("verified_customers"))
    return counts.select("orders", "verified_orders", "verified_customers", low.alias("low"), high.alias("high"))


def month_of(today: str, back: int) -> tuple[str, str]:
    """First and last day of the month ``back`` months before that of ``today``."""
    day = date.fromisoformat(today)
    months = 12 * day.year + day.month - 1 - back
    first, after = date(months // 12, months % 12 + 1, 1), date((months + 1) // 12, (months + 1) % 12 + 1, 1)
    return first.isoformat(), (after - timedelta(days=1)).isoformat()


def _segment(gap: Column) -> Column:
    return F.when(gap.isNull() | (gap >= DORMANT_DAYS), "New").when(gap <= RECENT_DAYS, "Repeat").otherwise("Lapsed")


def _segment_counts() -> list[Column]:
    one = lambda s: F.count(F.when(F.col("segment") == s, 1))
    everyone = F.count(F.lit(1))
    return [everyone.alias("customers"), *[one(s).alias(s.lower()) for s in ("New", "Repeat", "Lapsed")], *[percent(one(s), everyone).alias(f"{s.lower()}_pct") for s in ("New", "Repeat", "Lapsed")]]


def affinity_rows(shop: Shop, start: str, end: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Customers of the window by segment, in the order Repeat, Lapsed, New, then orders, spend, name."""
    now, day = _within(start, end), F.col("business_date")
    first = F.lit(start).cast("date")
    rows = metric_orders(shop, sources).groupBy("customer_id").agg(
        F.count(F.when(now, 1)).alias("evaluation_orders"), F.sum(F.when(now, F.col("total").cast("decimal(18,2)"))).alias("s"), F.min(F.when(now, day)).alias("a"), F.max(F.when(now, day)).alias("z"), F.max(F.when(day < first, day)).alias("prior"), F.min("name").alias("name"),
    ).filter("evaluation_orders > 0")
    gap = F.datediff(first, F.col("prior"))
    rows = rows.select("customer_id", "name", _segment(gap).alias("segment"), "evaluation_orders", F.col("s").cast("double").alias("evaluation_spend"), text_date(F.col("a")).alias("first_day"), text_date(F.col("z")).alias("last_day"), text_date(F.col("prior")).alias("prior_day"), gap.alias("gap_days"))
    place = F.when(F.col("segment") == "Repeat", 0).when(F.col("segment") == "Lapsed", 1).otherwise(2)
    return rows.orderBy(place, F.desc("evaluation_orders"), F.desc("evaluation_spend"), F.lower("name"), "customer_id")


def last_month_affinity(shop: Shop, today: str) -> DataFrame:
    """The segments of the full month before that of ``today``."""
    start, end = month_of(today, 1)
    return affinity_rows(shop, start, end).agg(*_segment_counts()).select(F.lit(start[:7]).alias("period"), "*")


def quick_view(shop: Shop, today: str) -> DataFrame:
    """Seven rates of this and the last months and last month's segments, from one pass."""
    this, last, before = (month_of(today, k) for k in range(3))
    day = F.col("business_date")
    n = lambda cond: F.count(F.when(cond, 1))
    each = metric_orders(shop).groupBy("customer_id").agg(
        n(_within(*this)).alias("n"), n(_within(*last)).alias("n1"), n(_within(before[0], last[1])).alias("n2"), n(day < F.lit(this[0]).cast("date")).alias("ever"),
        F.max(F.when(day < F.lit(last[0]).cast("date"), day)).alias("prior"),
    )
    gap = F.datediff(F.lit(last[0]).cast("date"), F.col("prior"))
    now = F.col("n") > 0
    part = {"this_month": now, "last_month": F.col("n1") > 0, "two_months": F.col("n2") > 0}
    returned = {k: now & ((F.col("n") >= 2) | (F.col(c) > 0)) for k, c in (("one_month", "n1"), ("two_month", "n2"), ("lifetime", "ever"))}
    retained = {"one_month": now & (F.col("n1") > 0), "two_month": now & (F.col("n2") > 0)}
    segment = lambda s: n((F.col("n1") > 0) & (_segment(gap) == s))
    return each.agg(
        n(part["this_month"]).alias("customers_this_month"), n(part["last_month"]).alias("customers_last_month"), n(part["two_months"]).alias("customers_two_months"),
        *[n(c).alias(f"returning_{k}") for k, c in returned.items()], *[percent(n(c), n(now)).alias(f"return_rate_{k}") for k, c in returned.items()],
        *[n(c).alias(f"retained_{k}") for k, c in retained.items()],
        percent(n(retained["one_month"]), n(part["last_month"])).alias("retention_rate_one_month"), percent(n(retained["two_month"]), n(part["two_months"])).alias("retention_rate_two_month"),
        percent(n(F.col("n") >= 2), n(now)).alias("repeat_rate_this_month"), percent(n(F.col("n1") >= 2), n(part["last_month"])).alias("repeat_rate_last_month"),
        *[segment(s).alias(f"affinity_{s.lower()}") for s in ("New", "Repeat", "Lapsed")], *[percent(segment(s), n(part["last_month"])).alias(f"affinity_{s.lower()}_pct") for s in ("New", "Repeat", "Lapsed")],
    )


def _months(shop: Shop, today: str, months: int | None) -> DataFrame:
    """month, start and end of the last months up to ``today``; a row a month."""
    months = DEFAULT_MONTHS if months is None else months
    if not 1 <= months <= MOST_MONTHS:
        raise ValueError(f"between 1 and {MOST_MONTHS} months")
    first = F.add_months(F.trunc(F.lit(today).cast("date"), "month"), -F.col("id").cast("int"))
    return shop.spark.range(months).select(first.alias("start")).select("start", F.date_format("start", "yyyy-MM").alias("month"), F.least(F.last_day("start"), F.lit(today).cast("date")).alias("end"))


def _by_month(shop: Shop, today: str, sources: Sequence[str] | None) -> DataFrame:
    """Per customer and month with orders: n and prior, the last day with orders before the month."""
    orders = metric_orders(shop, sources).filter(_within(None, today))
    each = orders.groupBy("customer_id", F.trunc("business_date", "month").alias("start")).agg(F.count(F.lit(1)).alias("n"), F.max("business_date").alias("last"))
    return each.withColumn("prior", F.lag("last").over(Window.partitionBy("customer_id").orderBy("start")))


def _labelled(months: DataFrame, counts: DataFrame) -> DataFrame:
    """``counts`` of every month of the table, zero where there are none, newest first."""
    out = months.join(counts, "start", "left").orderBy(F.desc("month"))
    return out.select("month", text_date(F.col("start")).alias("first_day"), text_date(F.col("end")).alias("last_day"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts.columns if c != "start"])


def affinity_trend(shop: Shop, today: str, months: int | None = None, sources: Sequence[str] | None = None) -> DataFrame:
    """Segments of every month's customers, from one job."""
    each = _by_month(shop, today, sources).withColumn("segment", _segment(F.datediff("start", "prior")))
    return _labelled(_months(shop, today, months), each.groupBy("start").agg(*_segment_counts()))


#: Days of lookback by name; lifetime has no end.
LOOKBACKS = {"30d": 30, "60d": 60, "lifetime": None}


def _seen(days: int | None) -> Column:
    return F.col("prior").isNotNull() if days is None else F.coalesce(F.datediff("start", "prior") <= days, F.lit(False))


def return_trend(shop: Shop, today: str, months: int | None = None, min_orders: int = 2, sources: Sequence[str] | None = None) -> DataFrame:
    """Return rate of every month with lookbacks of 30 and 60 days and of all time, from one job."""
    Filters(today, today, min_orders=min_orders).repeated("the return trend")
    everyone = F.count(F.lit(1))
    back = {k: F.count(F.when((F.col("n") >= min_orders) | _seen(d), 1)) for k, d in LOOKBACKS.items()}
    counts = _by_month(shop, today, sources).groupBy("start").agg(everyone.alias("customers"), *[c.alias(f"returning_{k}") for k, c in back.items()], *[percent(c, everyone).alias(f"return_rate_{k}") for k, c in back.items()])
    return _labelled(_months(shop, today, months), counts)


def retention_trend(shop: Shop, today: str, months: int | None = None, min_orders: int = 1, sources: Sequence[str] | None = None) -> DataFrame:
    """Retention of every month from cohorts of 30 and 60 days and of all time before it.

    A day with orders belongs to the cohorts of the two or three months that begin within 60 days
    after it, and a first day to the lifetime cohorts of all later months, which are running sums.
    """
    days = metric_orders(shop, sources).filter(_within(None, today)).select("customer_id", "business_date").distinct()
    next_month = F.add_months(F.trunc("business_date", "month"), 1)
    near = days.select("customer_id", "business_date", F.explode(F.sequence(next_month, F.date_add(next_month, 60), F.expr("INTERVAL 1 MONTH"))).alias("start")).withColumn("gap", F.datediff("start", "business_date")).filter("gap <= 60")
    cohort = near.groupBy("start", "customer_id").agg(F.min("gap").alias("gap")).groupBy("start").agg(F.count(F.when(F.col("gap") <= 30, 1)).alias("cohort_30d"), F.count(F.lit(1)).alias("cohort_60d"))
    first = days.groupBy("customer_id").agg(F.min("business_date").alias("first")).groupBy(F.add_months(F.trunc("first", "month"), 1).alias("since")).agg(F.count(F.lit(1)).alias("c"))
    table = _months(shop, today, months)
    ever = table.join(first, F.col("since") <= F.col("start")).groupBy("start").agg(F.sum("c").alias("cohort_lifetime"))  # months x months
    kept = _by_month(shop, today, sources).groupBy("start").agg(*[F.count(F.when((F.col("n") >= min_orders) & _seen(d), 1)).alias(f"retained_{k}") for k, d in LOOKBACKS.items()])
    counts = table.select("start").join(cohort, "start", "left").join(ever, "start", "left").join(kept, "start", "left")
    zero = counts.select("start", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts.columns if c != "start"])
    rates = [percent(F.col(f"retained_{k}"), F.col(f"cohort_{k}")).alias(f"retention_rate_{k}") for k in LOOKBACKS]
    return _labelled(table, zero.select("*", *rates))


def repeat_trend(shop: Shop, today: str, months: int | None = None, min_orders: int = 2, sources: Sequence[str] | None = None) -> DataFrame:
    Filters(today, today, min_orders=min_orders).repeated("the repeat trend")
    again, everyone = F.count(F.when(F.col("n") >= min_orders, 1)), F.count(F.lit(1))
    return _labelled(_months(shop, today, months), _by_month(shop, today, sources).groupBy("start").agg(everyone.alias("customers"), again.alias("repeating"), percent(again, everyone).alias("repeat_rate")))


def trailing_reorder(shop: Shop, monthly: DataFrame, months: int = 3) -> DataFrame:
    """Means of the last months' customers and repeat customers, and the ratio of their sums."""
    last = monthly.orderBy(F.desc("month")).limit(months)
    total = shop.customers.agg(F.count(F.when(F.col("is_verified"), 1)).alias("verified_customers"))
    out = last.agg(F.round(F.avg("customers")).cast("long").alias("customers"), F.round(F.avg("repeat_customers")).cast("long").alias("returning"), percent(F.sum("repeat_customers"), F.sum("customers")).alias("reorder_rate"))
    return out.join(F.broadcast(total))  # a row each


def was_customer_before(shop: Shop, customer_id: int, day: str) -> DataFrame:
    """Whether a customer has a successful order before the business date."""
    rows = shop.success.filter((F.col("customer_id") == customer_id) & (F.col("business_date") < F.lit(day).cast("date")))
    return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("returning"))

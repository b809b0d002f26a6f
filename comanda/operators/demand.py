"""Demand models on the item panel: will it sell, how much at the median and the 90th percentile."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.operators import quantiles
from comanda.operators.panel import COLD_DAYS, FEATURES, LAGS, time_split
from comanda.session import spread, written

#: Quantities of an item that its next day's features need.
CARRIED = 14
WEATHER_DAYS = 7


def _assembled(rows: DataFrame) -> DataFrame:
    filled = rows.na.fill(0.0, subset=FEATURES)  # lags that an item does not have yet
    vector = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    return vector.transform(filled).withColumn("_sold", (F.col("q") > 0).cast("double"))


def combined(rows: DataFrame) -> DataFrame:
    """``rows(probability, p50, p90)`` with the demand in their place: quantities if sold times the
    probability of a sale, and prep, what to prepare, between both. Crossed quantiles meet at the median."""
    low = F.greatest(F.lit(0.0), F.col("p50"))
    high = F.greatest(low, F.col("p90"))
    p50, p90 = F.col("probability") * low, F.col("probability") * high
    kept = [c for c in rows.columns if c not in ("p50", "p90", "prep")]
    return rows.select(*kept, p50.alias("p50"), p90.alias("p90"), F.ceil(p90 * 0.7 + p50 * 0.3).alias("prep"))


@dataclass
class Demand:
    """A boosted classifier and its calibration (None where training saw one class alone: then every
    item counts as sold), and boosted quantiles of what sold."""

    classifier: Model | None
    calibration: Model | None
    quantities: quantiles.BoostedQuantiles

    def predicted(self, rows: DataFrame) -> DataFrame:
        """``rows`` of features with probability, and the quantities p50 and p90 if sold."""
        scored = _assembled(rows)
        if self.classifier is None:
            scored = scored.withColumn("probability", F.lit(1.0))
        else:
            scored = self.classifier.transform(scored).withColumn("_raw", vector_to_array("probability")[1]).drop("prediction", "rawPrediction", "probability")
            scored = self.calibration.transform(scored).withColumnRenamed("prediction", "probability")
        p50, p90 = (F.greatest(F.lit(0.0), self.quantities.predicted(k)) for k in (0, 1))
        return scored.select(*rows.columns, "probability", p50.alias("p50"), F.greatest(p50, p90).alias("p90"))


def trained(rows: DataFrame, seed: int = 7, ready: bool = False) -> Demand:
    """Fits on ``features(training=True)`` rows: the calibration on the last fifth of the days with a
    classifier of the days before, the final classifier on all, the quantiles on what sold. ``ready`` rows are
    those of a written table."""
    rows = rows if ready else written(rows, "demand-features")  # read by every pass of the fits
    quantities = quantiles.fitted(rows.filter("q > 0"), "q", FEATURES)
    if rows.agg(F.count_distinct(F.col("q") > 0)).first()[0] < 2:
        return Demand(None, None, quantities)
    parts = time_split(_assembled(rows))
    gbt = GBTClassifier(featuresCol="_features", labelCol="_sold", maxIter=15, maxDepth=4, seed=seed)
    early, test = parts.filter("part = 'train'"), parts.filter("part = 'test'")
    if early.agg(F.count_distinct("_sold")).first()[0] < 2:
        early, test = parts, parts  # too few days to hold some out
    held = gbt.fit(early).transform(test).withColumn("_raw", vector_to_array("probability")[1])
    calibration = IsotonicRegression(featuresCol="_raw", labelCol="_sold").fit(held.select("_raw", "_sold"))
    return Demand(gbt.fit(_assembled(rows)), calibration, quantities)


def held_out(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """``features`` rows of the last days, as predicted by models of the first ``share`` of the days."""
    parts = written(time_split(rows, share), "demand-parts")
    model = trained(parts.filter("part = 'train'").drop("part"), ready=True)
    return model.predicted(parts.filter("part = 'test'").drop("part"))


def by_folds(rows: DataFrame, folds: list[str], done: DataFrame | None = None) -> DataFrame:
    """menu_item_id, day, actual, probability, p50, p90, prep: each fold day by a model of its own,
    fitted on the days before it alone. Days that ``done(day)`` has are left out.

    Features of a day are made of earlier days, so a fold reads nothing later than itself.
    """
    have = {str(r[0]) for r in done.select("day").distinct().collect()} if done is not None else set()  # a row a fold
    rows, out = written(rows, "demand-folds"), None
    for day in sorted(set(folds) - have):
        before = rows.filter(F.col("day") < F.lit(day).cast("date"))
        said = combined(trained(before).predicted(rows.filter(F.col("day") == F.lit(day).cast("date"))))
        said = written(said.select("menu_item_id", "day", F.col("q").alias("actual"), "probability", "p50", "p90", "prep"), "demand-fold")
        out = said if out is None else out.unionByName(said)
    return out


def carried(panel: DataFrame) -> DataFrame:
    """The state that the next day's features need, a row an item: category, price, median price, first
    day and ``recent``, its last CARRIED quantities, oldest first."""
    end = panel.agg(F.max("day")).first()[0]
    last = F.col("day") > F.date_sub(F.lit(end), CARRIED)
    state = panel.groupBy("menu_item_id").agg(
        F.max_by("category", "day").alias("category"), F.max_by("price", "day").alias("price"), F.percentile("price", 0.5).alias("item_median_price"), F.min("day").alias("first_day"),
        F.transform(F.array_sort(F.collect_list(F.when(last, F.struct("day", "q")))), lambda x: x["q"]).alias("recent"),  # CARRIED at most
    )
    return state


def last_weather(panel: DataFrame, days: int = WEATHER_DAYS) -> tuple[float, float]:
    """Means of temperature and rain over the last days of the panel."""
    by_day = panel.groupBy("day").agg(F.max("temperature").alias("t"), F.max("rain").alias("r")).orderBy(F.desc("day")).limit(days)
    return tuple(by_day.agg(F.avg("t"), F.avg("r")).first())


def next_features(state: DataFrame, day: str, temperature: float, rain: float) -> DataFrame:
    """FEATURES of every item of ``carried`` for the day that follows its quantities.

    Means of the store and of categories come from the same arrays: one pass over the items, whatever
    the length of the history.
    """
    back = state.select("category", F.posexplode(F.slice(F.reverse("recent"), 1, 7)).alias("back", "q"))
    kinds = back.groupBy("category", "back").agg(F.sum("q").alias("s"), F.count(F.lit(1)).alias("n"))
    store = kinds.groupBy("back").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.when(F.col("back") < 3, F.col("s"))).alias("all3"), F.sum("s").alias("all7"), F.avg(F.col("s") / F.col("n")).alias("mean"))
    kinds = kinds.groupBy(F.col("category").alias("kind")).agg(F.avg(F.col("s") / F.col("n")).alias("own"))
    rows = state.join(F.broadcast(kinds), state["category"].eqNullSafe(kinds["kind"]), "left").join(F.broadcast(store))  # a row a category, one row
    size = F.size("recent")
    total = lambda lo, hi: F.aggregate(F.slice(F.reverse("recent"), lo, hi - lo + 1), F.lit(0.0), lambda a, x: a + x)
    count = lambda lo, hi: F.greatest(F.lit(0), F.least(size, F.lit(hi)) - (lo - 1))
    mean = lambda lo, hi: total(lo, hi) / F.nullif(count(lo, hi), F.lit(0))
    at = F.lit(day).cast("date")
    weekend = F.when(F.weekday(at) >= 5, 1.0).otherwise(0.0)
    rest = lambda n: F.greatest(F.lit(0.0), F.coalesce(F.col(f"all{n}"), F.lit(0.0)) - total(1, n))
    values = {
        "day_of_week": F.weekday(at), "is_weekend": weekend, "month": F.month(at), "days_since_launch": F.datediff(at, "first_day"),
        "lag_1": F.get(F.reverse("recent"), F.lit(0)), "lag_7": F.get(F.reverse("recent"), F.lit(6)), "rolling_mean_7": mean(1, 7), "rolling_mean_14": mean(1, 14), "rolling_trend_3": mean(1, 3) - mean(4, 6),
        "temperature": F.lit(temperature), "rain": F.lit(rain), "price": F.col("price"), "item_median_price": F.col("item_median_price"),
        "price_ratio": F.when(F.col("item_median_price") > 0, F.col("price") / F.col("item_median_price")).otherwise(1.0),
        "category_avg_last7": F.coalesce("own", "mean", F.lit(0.0)), "global_avg_last7": F.coalesce("mean", F.lit(0.0)), "store_total_last3": rest(3), "store_total_last7": rest(7), "temp_weekend": F.lit(temperature) * weekend,
    }
    cold = lambda c: F.when(values["days_since_launch"] < COLD_DAYS, values["category_avg_last7"]).otherwise(values[c]) if c in LAGS else values[c]
    return rows.select(*[state[c] for c in state.columns if c not in FEATURES], F.col("price").alias("_price"), F.col("item_median_price").alias("_median"), at.alias("day"), F.lit(0.0).alias("q"), *[cold(c).cast("double").alias(c) for c in FEATURES])


def forecast(panel: DataFrame, demand: Demand, end: str, horizon: int = 14, weather: tuple[float, float] | None = None) -> DataFrame:
    """menu_item_id, day, probability, p50, p90, prep for the days after ``end``, one day after the
    other: the rounded median demand of a day is history for the next. Weather is the mean of the last days."""
    weather = weather or last_weather(panel)
    state, out = written(carried(spread(panel, panel.count(), "menu_item_id")), "demand-state"), None
    for k in range(1, horizon + 1):
        day = (date.fromisoformat(end) + timedelta(days=k)).isoformat()
        said = combined(demand.predicted(next_features(state, day, *weather)))
        said = written(said, "demand-day")
        state = said.select("menu_item_id", "category", F.col("_price").alias("price"), F.col("_median").alias("item_median_price"), "first_day", _slid("recent", F.bround("p50", 0)).alias("recent"))
        said = said.select("menu_item_id", "day", "probability", "p50", "p90", "prep")
        out = said if out is None else out.unionByName(said)
    return out


def _slid(recent: str, q: Column) -> Column:
    """The last CARRIED of an array and one more value."""
    longer = F.concat(F.col(recent), F.array(q))
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - CARRIED + 1), F.lit(CARRIED))

"""Incremental ingestion: cursor pages, latest-wins upserts, event-time windows, guarded SQL."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from comanda.functions.dates import OPENING, text_date
from comanda.sources.adapter import Shop


def page(feed: DataFrame, cursor: str, after: int, size: int) -> DataFrame:
    """The next page of a feed after a cursor value; at most 500 rows."""
    return feed.filter(F.col(cursor) > after).orderBy(cursor).limit(min(size, 500))


def start_cursor(loaded: DataFrame, cursor: str, customers: DataFrame) -> DataFrame:
    """Where the next pull begins: after the greatest cursor loaded, or anew (0) while there are no
    customers, for then an earlier load did not get through."""
    some = customers.limit(1).agg((F.count(F.lit(1)) > 0).alias("some"))
    last = loaded.agg(F.coalesce(F.max(cursor), F.lit(0)).alias("last"))
    return last.join(F.broadcast(some)).select(F.when(F.col("some"), F.col("last")).otherwise(F.lit(0)).cast("long").alias("cursor"))  # a row each


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key: the table after all upserts."""
    r = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(version)))
    return rows.withColumn("_r", r).filter("_r = 1").drop("_r")


def daily_windows(events: DataFrame) -> DataFrame:
    """Counts and sums by business day and type; the same plan serves batch and stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", "1 hour")
    days = timed.groupBy(F.window("ts", "1 day", "1 day", "5 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return days.select(text_date(F.to_date(F.col("w.start") - F.expr(OPENING))).alias("business_date"), "event_type", "events", "value")


def upsert_stream(source: DataFrame, target: str, key: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch, without replays, to the log under ``target``; ``latest`` reads the
    table from it. A batch that is tried again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, version).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VIEWS = ("orders", "items", "addons", "menu", "customers")


def read_only_sql(shop: Shop, query: str, limit: int | None = None, args: dict | None = None) -> DataFrame:
    """Runs a query over the canonical views, with named parameters; anything else is refused.

    A query is what can stand as a subquery: the parser accepts no command and no insert there, at
    any depth. SHOW, DESCRIBE and EXPLAIN read only and are allowed too.
    """
    text = query.strip().rstrip(";")
    for name in VIEWS:
        getattr(shop, name).createOrReplaceTempView(f"{name}_view")
    if text.split(None, 1)[:1] and text.split(None, 1)[0].upper() in ("SHOW", "DESCRIBE", "EXPLAIN"):
        return shop.spark.sql(text)
    try:
        shop.spark.sql(f"SELECT * FROM (\n{text}\n)", args=args or {})  # parsed and analysed, not run
    except ParseException as e:
        raise ValueError("only queries are allowed") from e
    rows = shop.spark.sql(text, args=args or {})
    return rows if limit is None else rows.limit(limit)


def dated_sql(shop: Shop, query: str, today: str) -> DataFrame:
    """``read_only_sql`` with :today_start, :today_end, :yesterday_start and :yesterday_end, the bounds
    of the business days, as parameters."""
    day = datetime.fromisoformat(today) + timedelta(hours=5)
    bounds = {"today_start": day, "today_end": day + timedelta(days=1), "yesterday_start": day - timedelta(days=1), "yesterday_end": day}
    return read_only_sql(shop, query, args={k: v.isoformat(" ") for k, v in bounds.items()})


def chart_rows(shop: Shop, config: str) -> DataFrame:
    """The rows of a stored chart (JSON with sql, x and y) from today's data, as x and y."""
    chart = json.loads(config)
    rows = read_only_sql(shop, chart["sql"])
    return rows.select(F.col(chart["x"]).cast("string").alias("x"), F.col(chart["y"]).cast("double").alias("y"))

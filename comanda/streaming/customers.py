"""Customers kept up to date by the order feed, batch by batch, in two versioned tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from comanda.session import written
from comanda.sources.payloads import key_of, opened
from comanda.streaming.versions import Table

_ORDERS = "order_id bigint, stream_id bigint, identity_key string, total double"
_CUSTOMERS = "identity_key string, name string, phone string, address string, first_order timestamp, last_order timestamp, total_orders bigint, total_spent double, is_verified boolean"


def _folded(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.identity_key") == F.col("b.identity_key"), "full_outer")
    first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    total = lambda c: (F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0))).alias(c)
    by_key = ~F.coalesce("a.identity_key", "b.identity_key").startswith("anon:")
    rows = both.select(
        *map(first, ("identity_key", "name", "phone", "address")), F.least("a.first_order", "b.first_order").alias("first_order"), F.greatest("a.last_order", "b.last_order").alias("last_order"),
        total("total_orders"), total("total_spent"), (F.coalesce("a.is_verified", F.lit(False)) | by_key).alias("is_verified"),
    )
    return rows.filter("total_orders > 0 or is_verified")


@dataclass(frozen=True)
class Customers:
    """A customer's name, phone and address are the first known ones; who is verified, by key or by hand,
    stays so. An order counts once: an event that comes again changes nothing, a later one of the same
    order moves its customer's counters by the difference, and takes the order from a former customer, who
    goes with the last order unless verified. First and last days are not taken back."""

    orders: Table
    customers: Table

    @classmethod
    def open(cls, spark: SparkSession, folder: str, buckets: int = 64) -> Customers:
        return cls(Table.create(spark, f"{folder}/orders", _ORDERS, ["order_id"], buckets), Table.create(spark, f"{folder}/customers", _CUSTOMERS, ["identity_key"], buckets))

    def ingest(self, feed: DataFrame, mark: int | None = None, survivors: DataFrame | None = None) -> None:
        """Takes in ``feed(payload)``. Counters are written before the orders that they are told from, so
        with marks a batch that broke off in between is taken up there. Orders of a customer in
        ``survivors(identity_key, survivor)`` count for the survivor."""
        rows = opened(feed, brief=True)
        seen = rows.select("order_id", "stream_id", key_of(rows).alias("identity_key"), F.col("Order.total").alias("total"), "created_on", F.coalesce(F.nullif(F.trim("Customer.name"), F.lit("")), F.lit("Anonymous")).alias("name"), F.nullif(F.trim("Customer.phone"), F.lit("")).alias("phone"), F.nullif(F.trim("Customer.address"), F.lit("")).alias("address"))
        if survivors is not None:
            seen = seen.join(survivors, "identity_key", "left").withColumn("identity_key", F.coalesce("survivor", "identity_key")).drop("survivor")
        seen = written(seen, "seen", "zstd")
        self.customers.change(self._differences(seen), _folded, mark)
        self.orders.upsert(seen.select("order_id", "stream_id", "identity_key", "total"), "stream_id", mark)

    def _differences(self, seen: DataFrame) -> DataFrame:
        """What each customer gains or loses by orders that are new or newer than those known."""
        known = self.orders.near(seen).select("order_id", F.col("stream_id").alias("_stream"), F.col("identity_key").alias("_key"), F.col("total").alias("_total"))
        fresh = seen.join(known, "order_id", "left").filter("_stream is null or stream_id > _stream")
        own = F.coalesce(F.col("_key") == F.col("identity_key"), F.lit(False))
        gains = fresh.withColumn("n", F.when(own, 0).otherwise(1)).withColumn("total", F.coalesce("total", F.lit(0.0)) - F.when(own, F.coalesce("_total", F.lit(0.0))).otherwise(0.0))
        losses = fresh.filter("_key <> identity_key").select(F.col("_key").alias("identity_key"), F.lit(-1).alias("n"), (-F.coalesce("_total", F.lit(0.0))).alias("total"))
        moves = gains.select("identity_key", "n", "total", "stream_id", "created_on", "name", "phone", "address").unionByName(losses, allowMissingColumns=True)
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("stream_id"))).alias(c)
        return moves.groupBy("identity_key").agg(*map(first, ("name", "phone", "address")), F.min("created_on").alias("first_order"), F.max("created_on").alias("last_order"), F.sum("n").alias("total_orders"), F.sum("total").alias("total_spent"))

    def verify(self, keys: DataFrame) -> None:
        """Marks customers, by identity_key, as verified by hand."""
        hit = lambda new: new.select("identity_key", F.lit(True).alias("_hit"))
        self.customers.change(keys.select("identity_key").distinct(), lambda old, new: old.join(hit(new), "identity_key", "left").withColumn("is_verified", F.col("is_verified") | F.coalesce("_hit", F.lit(False))))

    def follow(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes in a stream of events, a micro-batch at a time."""
        return source.writeStream.foreachBatch(self.ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

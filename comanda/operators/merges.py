"""Customer merges applied to the tables and taken back, many at once, with what each one needs for that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.operators.entities import merge_policy
from comanda.session import written

_FIELDS = ("phone", "address")
_BEFORE = "merge_id bigint, source bigint, target bigint, before_phone string, before_address string, before_verified boolean, is_undone boolean"


@dataclass(frozen=True)
class Book:
    """customers (customer_id, phone, address, is_verified), orders (order_id, customer_id, ...), addresses
    (address_id, copied_by, customer_id, lines and is_default; copied_by is the merge that copied it, else
    null), history (each merge with its target's fields before it) and moved (merge_id, order_id)."""

    customers: DataFrame
    orders: DataFrame
    addresses: DataFrame
    history: DataFrame
    moved: DataFrame

    @classmethod
    def new(cls, customers: DataFrame, orders: DataFrame, addresses: DataFrame) -> Book:
        spark = customers.sparkSession
        addresses = addresses.withColumn("copied_by", F.lit(None).cast("bigint"))
        return cls(customers, orders, addresses, spark.createDataFrame([], _BEFORE), spark.createDataFrame([], "merge_id bigint, order_id bigint"))

    def written(self) -> Book:
        """The same, written to the shared folder: after each wave, so that plans stay short."""
        return Book(*[written(getattr(self, name), name) for name in self.__dataclass_fields__])


def _now(merges: DataFrame, rank: Column) -> DataFrame:
    """``merges`` with ``now``: whether none of smaller rank has its source in either role or its target as
    a source. Many sources may go into one target at once."""
    rows = merges.withColumn("_rank", rank)
    least = lambda role, on: rows.groupBy(F.col(role).alias(on)).agg(F.min("_rank").alias(f"_{role}_of_{on}"))
    rows = rows.join(least("source", "source"), "source").join(least("target", "source"), "source", "left").join(least("source", "target"), "target", "left")
    free = (F.col("_rank") == F.col("_source_of_source")) & (F.col("_rank") <= F.coalesce("_target_of_source", "_rank")) & (F.col("_rank") <= F.coalesce("_source_of_target", "_rank"))
    return rows.select(*merges.columns, free.alias("now"))


def _line() -> Column:
    return F.lower(F.concat_ws("|", *[F.trim(c) for c in ("address_line_1", "address_line_2", "city")]))


def _copies(book: Book, merges: DataFrame) -> DataFrame:
    """Addresses that targets lack, each once, by the first merge that has it; a default one stays that
    only where the target has none yet."""
    lines = book.addresses.withColumn("_line", _line())
    own = lines.groupBy(F.col("customer_id").alias("target")).agg(F.max("is_default").alias("_has"))
    new = merges.select("merge_id", "source", "target").join(lines.withColumnRenamed("customer_id", "source"), "source")
    new = new.join(lines.select(F.col("customer_id").alias("target"), "_line").distinct(), ["target", "_line"], "left_anti")
    order = F.struct("merge_id", ~F.col("is_default"), "address_id", "copied_by")
    first = new.groupBy("target", "_line").agg(F.min_by(F.struct(*[c for c in new.columns if c not in ("target", "_line")]), order).alias("r")).select("target", "r.*")
    default = first.filter("is_default").groupBy("target").agg(F.min(F.struct("merge_id", "address_id")).alias("_d"))
    rows = first.join(own, "target", "left").join(default, "target", "left")
    stays = F.col("is_default") & ~F.coalesce("_has", F.lit(False)) & (F.struct("merge_id", "address_id") == F.col("_d"))
    return rows.withColumn("is_default", F.coalesce(stays, F.lit(False))).withColumn("copied_by", F.col("merge_id")).withColumn("customer_id", F.col("target")).select(*book.addresses.columns)


def apply(book: Book, merges: DataFrame) -> tuple[Book, DataFrame]:
    """The tables after ``merges(merge_id, source, target, mark_verified)``, as if done one by one in the
    order of merge_id, and merge_id with ``status``: applied, refused (unknown or same customers, or a
    verified one into an unverified), or later, where an earlier merge has to be done first.

    Orders move, phone and address fill gaps of the target, addresses are copied, and a pair of unverified
    customers becomes verified if ``mark_verified`` says so. The merges of one target are sorted in one
    task, which holds few of them at a time.
    """
    flags = lambda k, p: book.customers.select(F.col("customer_id").alias(k), F.col("is_verified").alias(f"{p}v"), *[F.col(c).alias(f"{p}{c}") for c in _FIELDS])
    asked = written(_now(merges.filter("source <> target"), F.col("merge_id")), "asked")
    rows = asked.filter("now").join(flags("source", "s"), "source").join(flags("target", "t"), "target")
    before = Window.partitionBy("target").orderBy("merge_id").rowsBetween(Window.unboundedPreceding, -1)
    marks = F.coalesce("mark_verified", F.lit(False)) & ~F.col("sv")
    rows = rows.withColumn("before_verified", F.col("tv") | F.coalesce(F.max(marks).over(before), F.lit(False))).filter(merge_policy(F.col("sv"), F.col("before_verified")) != "error")
    for c in _FIELDS:
        rows = rows.withColumn(f"before_{c}", F.coalesce(f"t{c}", F.first(f"s{c}", ignorenulls=True).over(before)))
    done = written(rows.withColumn("marks", marks), "merges")

    filled = done.groupBy(F.col("target").alias("customer_id")).agg(*[F.min_by(f"s{c}", F.when(F.col(f"s{c}").isNotNull(), F.col("merge_id"))).alias(f"_{c}") for c in _FIELDS], F.max("marks").alias("_marks"))
    customers = book.customers.join(filled, "customer_id", "left")
    for c in _FIELDS:
        customers = customers.withColumn(c, F.coalesce(c, f"_{c}"))
    customers = customers.withColumn("is_verified", F.col("is_verified") | F.coalesce("_marks", F.lit(False))).select(*book.customers.columns)
    to = done.select(F.col("source").alias("customer_id"), "target", "merge_id")
    orders = book.orders.join(to, "customer_id", "left")
    history = done.select("merge_id", "source", "target", "before_phone", "before_address", "before_verified", F.lit(False).alias("is_undone"))
    status = merges.select("merge_id").join(asked.select("merge_id", "now"), "merge_id", "left").join(done.select("merge_id", F.lit(True).alias("_done")), "merge_id", "left")
    status = status.select("merge_id", F.when(F.col("_done"), "applied").when(~F.col("now"), "later").otherwise("refused").alias("status"))
    return Book(
        customers, orders.withColumn("customer_id", F.coalesce("target", "customer_id")).select(*book.orders.columns), book.addresses.unionByName(_copies(book, done)),
        book.history.unionByName(history), book.moved.unionByName(orders.filter("merge_id is not null").select("merge_id", "order_id")),
    ), status


def undo(book: Book, merges: DataFrame) -> tuple[Book, DataFrame]:
    """The tables after ``merges(merge_id)`` are taken back, the last one first, and their ``status``: undone,
    refused (unknown or undone before), or later, where a later one has to be taken back first.

    Orders that a merge moved and that are still its target's go back to its source, addresses that it copied
    go, and its target gets the fields from before it.
    """
    known = merges.select("merge_id").distinct().join(book.history.filter(~F.col("is_undone")), "merge_id")
    asked = written(_now(known, -F.col("merge_id")), "asked")
    done = asked.filter("now")
    back = book.moved.join(done.select("merge_id", "source", "target"), "merge_id").select("order_id", "source", "target")
    orders = book.orders.join(back, "order_id", "left").withColumn("customer_id", F.when(F.col("customer_id") == F.col("target"), F.col("source")).otherwise(F.col("customer_id"))).select(*book.orders.columns)
    addresses = book.addresses.join(done.select(F.col("merge_id").alias("copied_by"), F.col("target").alias("customer_id")), ["copied_by", "customer_id"], "left_anti").select(*book.addresses.columns)
    names = ("phone", "address", "verified")
    first = done.groupBy(F.col("target").alias("customer_id")).agg(F.min_by(F.struct(*[F.col(f"before_{c}").alias(c) for c in names]), "merge_id").alias("_b"))
    fields = book.customers.join(first, "customer_id", "left")
    for c, b in zip((*_FIELDS, "is_verified"), names):
        fields = fields.withColumn(c, F.when(F.col("_b").isNotNull(), F.col(f"_b.{b}")).otherwise(F.col(c)))
    hit = done.select("merge_id", F.lit(True).alias("_u"))
    history = book.history.join(hit, "merge_id", "left").withColumn("is_undone", F.col("is_undone") | F.coalesce("_u", F.lit(False))).select(*book.history.columns)
    status = merges.select("merge_id").join(asked.select("merge_id", "now"), "merge_id", "left")
    status = status.select("merge_id", F.when(F.col("now"), "undone").when(~F.col("now"), "later").otherwise("refused").alias("status"))
    return Book(fields.select(*book.customers.columns), orders, addresses, history, book.moved), status


def contexts(book: Book) -> DataFrame:
    """Each merge with its target's fields before it, the orders that it moved and the addresses that it
    copied and that are still there."""
    moved = book.moved.groupBy("merge_id").agg(F.count(F.lit(1)).alias("orders_moved"))
    copied = book.addresses.filter("copied_by is not null").groupBy(F.col("copied_by").alias("merge_id")).agg(F.count(F.lit(1)).alias("addresses_copied"))
    return book.history.join(moved, "merge_id", "left").join(copied, "merge_id", "left").na.fill(0, ["orders_moved", "addresses_copied"])

"""Tables that change, as data: upserts, replacements, outbound batches, event ledgers, logs and caches.

Parquet has no rows to update in place. Each operator gives the table after the change; a caller
writes it as a new version, so a run that is repeated gives the same table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keyed(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    cond = F.lit(True)
    for k in key:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` put in: a new value wins over the old, but in columns ``keep``
    an old value that is not null stays. Both have unique keys."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    value = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")) if c in key or c in keep else F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with whole rows replaced; columns that ``new`` lacks become null."""
    return old.join(new, _keyed(old, new, key), "left_anti").unionByName(new, allowMissingColumns=True)


def inserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks, each key once."""
    return old.unionByName(new.dropDuplicates(key).join(old, _keyed(new, old, key), "left_anti"))


def next_batch(rows: DataFrame, sent: DataFrame, key: list[str], order: str, size: int, own_origin: str | None = None) -> DataFrame:
    """The oldest rows that were not sent yet; rows of another origin than ``own_origin`` never go out."""
    open_rows = rows if own_origin is None else rows.filter(F.col("origin") == own_origin)
    return open_rows.join(sent, _keyed(open_rows, sent, key), "left_anti").orderBy(order, *key).limit(size)


def marked_sent(sent: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    return sent.select(*key).unionByName(batch.select(*key)).distinct()


def new_events(incoming: DataFrame, applied: DataFrame, own: DataFrame) -> DataFrame:
    """Events to apply: each remote_id once, none applied before, none that began here (its local_id in
    ``own``)."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy("remote_id").orderBy("seq"))).filter("_n = 1").drop("_n")
    return first.join(applied, "remote_id", "left_anti").join(own, "local_id", "left_anti")


def replay_page(events: DataFrame, cursor: int, size: int) -> DataFrame:
    """The next page in order with ``applies``: whether no event of it or before it failed; the cursor
    moves past the page only if all apply."""
    page = events.filter(F.col("seq") > cursor).orderBy("seq").limit(size)
    upto = Window.partitionBy(F.lit(1)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)  # a page
    failed = F.sum((~F.col("ok")).cast("int"))
    marked = page.withColumn("applies", failed.over(upto) == 0)
    whole = failed.over(Window.partitionBy(F.lit(1))) == 0
    return marked.withColumn("next_cursor", F.when(whole, F.max("seq").over(Window.partitionBy(F.lit(1)))).otherwise(F.lit(cursor)))


def undone_events(undos: DataFrame, applied: DataFrame) -> DataFrame:
    """undo_id, remote_id and way: the applied event that each undo means, by the event id that it
    reverts, else the last event of its source and target."""
    events = applied.select("remote_id", "source", "target", "seq")
    by_id = undos.join(events.select(F.col("remote_id").alias("reverts_id"), "remote_id"), "reverts_id").select("undo_id", "remote_id", F.lit("event").alias("way"))
    rest = undos.join(by_id.select("undo_id"), "undo_id", "left_anti")
    last = events.groupBy("source", "target").agg(F.max_by("remote_id", "seq").alias("remote_id"))
    return by_id.unionByName(rest.join(last, ["source", "target"]).select("undo_id", "remote_id", F.lit("entity").alias("way")))


def to_emit(history: DataFrame) -> DataFrame:
    """Local changes to tell others; what came from the cloud is not told back."""
    return history.filter(F.col("origin") != "cloud")


def missing_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """(merge_id, event_type) that the history implies and the event log lacks."""
    merges = history.select("merge_id", F.lit("merge").alias("event_type"))
    undone = history.filter("undone").select("merge_id", F.lit("undo").alias("event_type"))
    return merges.unionByName(undone).join(events, ["merge_id", "event_type"], "left_anti")


def signed(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key, with a signature: SHA-256 of its columns as a JSON object,
    in the order of their names, so that different rows sign differently."""
    names = sorted(c for c in rows.columns if c != order)
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.col(order)).alias("r")).select(*key, "r.*")
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return last.withColumn("signature", F.sha2(text, 256))


def conversations_to_sync(conversations: DataFrame, messages: DataFrame, size: int = 50) -> DataFrame:
    """The oldest conversations never synced or changed since, each with its messages in order."""
    due = conversations.filter(F.col("synced_at").isNull() | (F.col("synced_at") < F.col("updated_at"))).orderBy("updated_at", "conv_id").limit(size)
    said = messages.join(F.broadcast(due.select("conv_id")), "conv_id")  # so many conversations at most
    nested = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return due.join(nested, "conv_id", "left")


def cache_put(cache: DataFrame, new: DataFrame, capacity: int) -> DataFrame:
    """The cache (key, value, created, used) with new entries, without the longest unused ones beyond
    the capacity."""
    return evicted(upserted(cache, new, ["key"]), capacity)


def evicted(cache: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` entries that were last used or made most lately."""
    return cache.orderBy(F.desc(F.coalesce("used", "created")), F.desc("key")).limit(capacity)


def cache_get(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key)`` with the cached value and whether there was one; entries marked wrong do not count."""
    good = cache.filter(~F.coalesce("is_wrong", F.lit(False))) if "is_wrong" in cache.columns else cache
    return asked.join(good.select("key", "value"), "key", "left").withColumn("hit", F.col("value").isNotNull())


def diverse(answers: DataFrame, most: int = 5) -> DataFrame:
    """At most so many different answers to each key, the latest ones."""
    once = answers.groupBy("key", "value").agg(F.max("created").alias("created"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("created"), "value"))).filter(F.col("n") <= most).drop("n")


def log_rows(calls: DataFrame, limit: int = 2000) -> DataFrame:
    """Interaction log rows: a payload longer than ``limit`` is kept as its size and digest beside the start."""
    long = F.length("payload") > limit
    summary = F.concat(F.substr("payload", F.lit(1), F.lit(200)), F.lit("... ["), F.length("payload").cast("string"), F.lit(" characters, "), F.substr(F.sha2("payload", 256), F.lit(1), F.lit(16)), F.lit("]"))
    return calls.withColumn("is_summary", F.coalesce(long, F.lit(False))).withColumn("payload", F.when(long, summary).otherwise(F.col("payload")))

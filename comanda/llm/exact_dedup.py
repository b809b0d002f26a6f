"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL functions alone.

A text's digest is the SHA-256 of its UTF-8 bytes. Misra-Gries summaries (Spark's ``approx_top_k``,
a merging variant) over buckets of digests name the digests that may be frequent; exact counts
verify them. A winner has more than one row in SHARE, so there are fewer than SHARE winners at any
size: they are broadcast, and their rows but the one that stays leave on the map side. All other
digests, and the rows that stay for the winners, meet in an ordinary shuffle, where no group is
larger than a SHARE-th of the rows but for what a summary has missed. Missed or not, the result is
the same.

Defined cases: null text is empty; empty texts are one group; of equal texts the row of the largest
doc_id stays, null doc_ids come last, and of rows that repeat both, one stays (the greatest hash of
the other columns); an empty table gives an empty result; further columns, also of clashing names,
are kept by ``deduplicated`` and not read by ``judged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.llm.common import set_aside
from comanda.session import written

#: A digest is heavy with more than one row in SHARE.
SHARE = 1 << 14
#: Summaries, and the counters of each: a digest of over about 1 row in 2 * SHARE is among them unless
#: most of the other rows lie in its bucket.
BUCKETS, COUNTERS = 16, 6144


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def heavy_digests(rows: DataFrame) -> DataFrame:
    """_digest, _n, _stays of the heavy digests of ``rows(_digest, _rank)``: exact number of rows and
    greatest rank. Fewer than SHARE rows."""
    hashed = F.xxhash64("_digest")
    summaries = rows.select(hashed.alias("_hash")).groupBy(F.pmod("_hash", F.lit(BUCKETS)).alias("bucket")).agg(F.expr(f"approx_top_k(_hash, {SHARE // BUCKETS}, {COUNTERS})").alias("top"))
    likely = written(summaries.select(F.explode("top.item").alias("_hash")), "likely-heavy")  # at most SHARE rows
    exact = rows.withColumn("_hash", hashed).join(F.broadcast(likely), "_hash", "left_semi").groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_rank").alias("_stays"))
    return written(exact.filter((F.col("_n") > 1) & (F.col("_n") * SHARE > rows.count())), "heavy")


def _decided(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """``rows(_digest, _rank, ...)`` with _keep_id, _group_size and _kept."""
    told = rows.join(F.broadcast(heavy), "_digest", "left")
    goes = F.col("_n").isNotNull() & ~F.col("_rank").eqNullSafe(F.col("_stays"))
    gone = told.filter(goes).select(*rows.columns, F.col("_stays.id").alias("_keep_id"), F.col("_n").alias("_group_size"), F.lit(False).alias("_kept"))
    group = Window.partitionBy("_digest")
    order = group.orderBy(F.col("_rank").desc())
    left = told.filter(~goes).withColumn("_place", F.row_number().over(order)).withColumn("_count", F.count(F.lit(1)).over(group)).withColumn("_first", F.max("_rank").over(group))
    left = left.select(*rows.columns, F.col("_first.id").alias("_keep_id"), F.coalesce("_n", "_count").alias("_group_size"), (F.col("_place") == 1).alias("_kept"))
    return gone.unionByName(left)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs(doc_id, text)``."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("_digest"))
    rows = written(slim, "digests").withColumn("_rank", F.struct(F.col("doc_id").alias("id")))
    out = _decided(rows, heavy_digests(rows.select("_digest", "_rank")))
    return out.select("doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The texts themselves go through one shuffle; copies of heavy texts do not.
    """
    aside, restored = set_aside(docs, ("doc_id", "text"))
    others = [c for c in aside.columns if c not in ("doc_id", "text")]
    rank = F.struct(F.col("doc_id").alias("id"), F.xxhash64(*others).alias("tie") if others else F.lit(0).alias("tie"))
    rows = aside.withColumn("_digest", digest(F.col("text"))).withColumn("_rank", rank)
    heavy = heavy_digests(written(rows.select("_digest", "_rank"), "digests"))
    return restored(_decided(rows, heavy).filter("_kept"))

"""Canonical exact fingerprints of texts, in DataFrame and SQL functions alone.

A text is normalised (NFKC), case folded and its white space folded; two seeds of xxhash64 over the
canonical text make a 128-bit digest. Digests are counted first; the texts of buckets with more
than one row are then compared byte by byte, as least and greatest text of the bucket, which tasks
pre-aggregate, so a large group of copies reaches its bucket as one row a task; a bucket that holds
different texts (a hash collision) gets fingerprints lengthened by SHA-256. In the registered query
a text, its edited form and the next text stand in one row, so their likeness is an equality of
canonical bytes; edited texts meet all other rows' buckets by their SHA-256.

Defined cases: null text is empty; empty texts share one fingerprint; repeated rows share theirs;
null doc_ids come first in the order of documents, and equal doc_ids follow their texts; an empty
table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.llm.common import set_aside
from comanda.session import written

DOCS_A_BLOCK, MOST_BLOCKS = 2000, 1 << 14
#: Repeated digests are sent to the texts up to this many (about 20 MB), and joined beyond it.
SENT_DIGESTS = 200_000
NO_ID = -(1 << 63)


def canonical(text: Column) -> Column:
    compose = lambda x: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    spaced = F.regexp_replace(compose(fold(compose(F.coalesce(text, F.lit(""))))), r"[\s\p{Z}]+", " ")
    return F.btrim(spaced)


def digest(canon: Column) -> Column:
    part = lambda seed: F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0"))
    return F.concat(part(1), part(2))


def collisions(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """digest: those that different canonical texts of ``docs(text)`` share; ``digests(digest)`` has a
    row for each document."""
    many = written(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "repeated")
    if many.count() <= SENT_DIGESTS:
        many = F.broadcast(many)
    canon = canonical(F.col("text"))
    same = docs.select(digest(canon).alias("digest"), canon.alias("canon")).join(many, "digest", "left_semi")
    buckets = same.groupBy("digest").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    return written(buckets.filter("least <> most").select("digest"), "collisions")


def fingerprint_of(canon_digest: Column, canon_sha: Column, collides: Column) -> Column:
    return F.when(collides, F.concat(canon_digest, canon_sha)).otherwise(canon_digest)


def fingerprinted(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``docs`` with their fingerprint as ``name``; equal fingerprints mean equal canonical texts."""
    docs, restored = set_aside(docs, ("text",))
    bad = collisions(docs.select("text"), docs.select(digest(canonical(F.col("text"))).alias("digest"))).select(F.col("digest").alias("_bad"))
    rows = docs.withColumn("_canon", canonical(F.col("text"))).withColumn("_digest", digest(F.col("_canon")))
    joined = rows.join(bad, rows["_digest"] == bad["_bad"], "left")
    out = joined.withColumn("_fingerprint", fingerprint_of(F.col("_digest"), F.sha2("_canon", 256), F.col("_bad").isNotNull()))
    return restored(out, F.col("_fingerprint").alias(name))


def _blocked(ids: Column, bounds: list[int]) -> Column:
    """The number of ``bounds`` that an id reaches, by two short searches."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    reached = lambda values: F.size(F.filter(values, lambda b: b <= ids))
    coarse = reached(F.array(*[F.lit(r[0]) for r in runs]))
    fine = F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in runs]), coarse)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + reached(fine))


def with_next(docs: DataFrame, docs_a_block: int = DOCS_A_BLOCK) -> DataFrame:
    """doc_id, text and next_text: the text of the next document in ascending doc_id, and of the
    first after the last. Null texts are empty.

    Documents are dealt to blocks of neighbouring ids, bounded by quantiles; a block's last
    document takes the first text of the next block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    n = rows.count()
    n_blocks = min(MOST_BLOCKS, -(-n // docs_a_block))
    bounds: list[int] = []
    if n_blocks > 1:
        shares = [k / n_blocks for k in range(1, n_blocks)]
        bounds = sorted(set(keyed.agg(F.percentile_approx("id", shares, max(10_000, 4 * n_blocks))).first()[0]))
    keyed = keyed.withColumn("block", _blocked(F.col("id"), bounds))
    ids = keyed.groupBy("block").agg(F.min("id").alias("id"))
    firsts = keyed.join(F.broadcast(ids), ["block", "id"]).groupBy("block").agg(F.min("text").alias("text"))  # at most MOST_BLOCKS rows
    around = Window.partitionBy(F.lit(1)).orderBy("block")
    order = ids.select("block", F.coalesce(F.lead("block").over(around), F.min("block").over(Window.partitionBy(F.lit(1)))).alias("after"))
    first_after = order.join(firsts.select(F.col("block").alias("after"), F.col("text").alias("after_text")), "after").select("block", "after_text")
    inside = keyed.withColumn("lead_text", F.lead("text").over(Window.partitionBy("block").orderBy("id", "text")))
    joined = inside.join(first_after, "block", "left")
    return joined.select("doc_id", "text", F.coalesce("lead_text", "after_text").alias("next_text"))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, text, next_text and edited: the text with its last quarter replaced by the
    beginning of the next document."""
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    put = F.concat(F.substr(F.col("text"), F.lit(1), n - k), F.substr(F.col("next_text"), F.lit(1), k))
    return with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), "text", "next_text", put.alias("edited"))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: the
    fingerprint of every text, of its edited form and of the next document. Exact fingerprints are
    alike (1.0) or not (0.0)."""
    rows = edited(docs)
    own, other, after = (canonical(F.col(c)) for c in ("text", "edited", "next_text"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), own.alias("own"), other.alias("other"), after.alias("after"))
    bytes_equal = lambda a: (F.col("own") == F.col(a)).cast("double")
    rows = written(
        rows.select(
            "doc_id", "n_chars", "edited_sha256", digest(F.col("own")).alias("own_digest"), F.sha2("own", 256).alias("own_sha"), digest(F.col("other")).alias("other_digest"), F.sha2("other", 256).alias("other_sha"),
            bytes_equal("other").alias("near_edited"), bytes_equal("after").alias("near_next"),
        ),
        "fingerprints",
    )
    bad = collisions(docs.select("text"), rows.select(F.col("own_digest").alias("digest")))
    every = rows.select(F.col("own_digest").alias("digest"), F.col("own_sha").alias("sha")).unionByName(rows.select(F.col("other_digest").alias("digest"), F.col("other_sha").alias("sha")))
    told = every.groupBy("digest").agg(F.min("sha").alias("least"), F.max("sha").alias("most")).filter("least <> most").select("digest")
    bad = written(bad.unionByName(told).distinct(), "all-collisions")
    out = rows
    if not bad.isEmpty():
        for name in ("own", "other"):
            of_name = bad.select(F.col("digest").alias(f"{name}_digest"), F.lit(True).alias("_bad"))
            out = out.join(of_name, f"{name}_digest", "left").withColumn(f"{name}_digest", fingerprint_of(F.col(f"{name}_digest"), F.col(f"{name}_sha"), F.col("_bad").isNotNull())).drop("_bad")
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("own_digest").alias("fingerprint"), F.col("other_digest").alias("edited_fingerprint"), "near_edited", "near_next")

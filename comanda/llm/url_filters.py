"""URL rules, and a list of URLs behind a blocked Bloom filter, in DataFrame functions alone.

The longest rule that fits a URL decides; of equally long ones that fit, the last by code point. For
the rest, the canonical URL is looked for in a list: a split-block Bloom filter (blocks of eight
32-bit words, one bit set in each) lets possible hits pass, and a hash join on the canonical URL
itself removes the false ones. Rows that the filter turns away are never shuffled while the filter
is small enough to be sent; possible hits are salted, since one listed URL may hold many rows.

Defined cases: a null url, and one without ``://``, has empty host and path, fits no rule and is in
no list; null page_ids and repeated rows are judged one by one; null entries of the list count for
nothing, repeated ones once; an empty list blocks nothing; empty tables give empty results; further
columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.session import written

#: The rules of the registered query, as (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
WORDS = 8
BITS_A_KEY = 16
#: The filter is sent to all executors up to this many blocks (32 bytes each), else joined by block.
SENT_BLOCKS = 1 << 18
#: Parts that possible hits of one URL are dealt to.
SALTS = 16
#: Words in host names of the registered query's list.
SPAM = "casino|bets|pills"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without www. and default port, path without index page and last slash, and the query's
    other parameters in order; scheme and fragment go. Null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null where none fits. Meant for rule lists that
    fit a plan (hundreds); whole URLs by the million belong into the list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """One bit for each of the eight words of a block."""
    h = F.xxhash64(F.lit("bit"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(h, 5 * k).bitwiseAND(F.lit(31)).cast("int")) for k in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n_blocks))


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """``listed(canonical)`` as rows (block, w0..w7)."""
    bits = _bits(F.col("canonical"))
    rows = listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def list_filter(listed: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(distinct canonical URLs of ``listed(canonical)``, their Bloom filter, its number of blocks)."""
    keys = written(listed.filter("canonical is not null").select("canonical").distinct(), "url-list")
    n_blocks = max(1, math.ceil(keys.count() * BITS_A_KEY / (32 * WORDS)))
    return keys, bloom_filter(keys, n_blocks), n_blocks


def with_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` with ``listed``: whether ``listed(canonical)`` has their ``canonical``."""
    keys, bloom, n_blocks = list_filter(listed)
    if n_blocks <= SENT_BLOCKS:
        bloom = F.broadcast(bloom)
    hit = F.lit(True)
    for k, b in enumerate(_bits(F.col("canonical"))):
        hit = hit & (F.col(f"w{k}").bitwiseAND(b) == b)
    bloom = bloom.withColumnRenamed("block", "_listed_block")
    asked = rows.withColumn("_block", _block(F.col("canonical"), n_blocks)).join(bloom, F.col("_block") == F.col("_listed_block"), "left")
    asked = asked.withColumn("_possible", F.coalesce(hit, F.lit(False))).select(*rows.columns, "_possible")
    never = asked.filter("not _possible").withColumn("listed", F.lit(False))
    maybe = asked.filter("_possible").withColumn("_salt", F.pmod(F.xxhash64("page_id", "canonical"), F.lit(SALTS)).cast("int"))
    salted = keys.select(F.col("canonical").alias("_key"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_key_salt"))
    # a merge join: salted keys are many and must not be taken for small
    found = maybe.join(salted.hint("merge"), (F.col("canonical") == F.col("_key")) & (F.col("_salt") == F.col("_key_salt")), "left").withColumn("listed", F.col("_key").isNotNull())
    return never.select(*rows.columns, "listed").unionByName(found.select(*rows.columns, "listed"))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of ``pages(page_id, url)``.

    ``listed(canonical)`` names the blocked canonical URLs; where no rule fits they decide. Rows
    that a rule decides are not looked up and count as not listed.
    """
    rule, verdict = rule_and_verdict(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("canonical"))
    rows = rows.withColumn("rule", rule).withColumn("_by_rule", verdict)
    # a row that a rule decides asks for null, which no list has
    asked = rows.withColumn("canonical", F.when(F.col("rule").isNull(), F.col("canonical")))
    both = with_listed(asked, listed)
    verdict = F.coalesce("_by_rule", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def spam_list(pages: DataFrame) -> DataFrame:
    """canonical: the list of the registered query. It stands for a delivered block list: the
    canonical URLs of pages on hosts with a word of SPAM, and as many that no page has."""
    urls = pages.select(host_of(F.col("url")).alias("host"), canonical_url(F.col("url")).alias("canonical")).filter(F.col("host").rlike(SPAM) & F.col("canonical").isNotNull())
    return urls.select(F.explode(F.array("canonical", F.concat("canonical", F.lit("/gone")))).alias("canonical"))

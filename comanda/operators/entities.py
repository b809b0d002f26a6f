"""Identity resolution, merges, table browsing, constraints and text matching."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from comanda.functions.text import contains_ci, identity_key, uuid5
from comanda.operators.cosine import nearest
from comanda.session import written
from comanda.sources.adapter import Shop

#: Fixed value: the namespace of the menu's identifiers.
NAMESPACE = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def identity_keys(shop: Shop) -> DataFrame:
    """Customers keyed by phone, name and address, or anonymous, from derived contact columns."""
    phone = F.when(F.col("customer_id") % 3 == 0, F.format_string("+91 98%08d", "customer_id"))
    address = F.when(F.col("customer_id") % 3 == 1, F.concat(F.lit("Nation  "), F.col("nation").cast("string")))
    rows = shop.customers.select("customer_id", identity_key(phone, F.col("name"), address, F.col("customer_id")).alias("identity_key"))
    return rows.withColumn("is_verified", ~F.col("identity_key").startswith("anon:"))


def menu_ids(shop: Shop) -> DataFrame:
    """Stable version-5 identifiers of (name, type), with how many source items share one."""
    rows = shop.menu.groupBy(F.lower(F.trim("name")).alias("name"), F.lower(F.trim("type")).alias("type")).agg(F.count(F.lit(1)).alias("sources"))
    return rows.select("name", "type", "sources", uuid5(NAMESPACE, F.col("name"), F.col("type")).alias("menu_uuid"))


def merge_policy(source_verified: Column, target_verified: Column) -> Column:
    """Which rule a merge of two customers falls under; a verified one never goes into an unverified
    one, and of two unverified ones somebody says whether the result is verified."""
    s, t = F.coalesce(source_verified, F.lit(False)), F.coalesce(target_verified, F.lit(False))
    return F.when(s & ~t, "error").when(s & t, "verified_pair").when(t, "into_verified_target").otherwise("unverified_pair")


def active_merges(log: DataFrame) -> DataFrame:
    """The latest state of each merge in an event log (merge_id, event_type, seq, source, target)."""
    latest = log.withColumn("r", F.row_number().over(Window.partitionBy("merge_id").orderBy(F.desc("seq")))).filter("r = 1")
    return latest.filter("event_type = 'merge'").select("merge_id", "source", "target")


def survivors(merges: DataFrame) -> DataFrame:
    """(source, survivor) along chains of any length: each round doubles the steps taken.

    Members of a cycle have no survivor among the targets; the least of the cycle is taken, so that
    all its members agree. Every round is written, so plans stay short.
    """
    state = written(merges.select("source", F.col("target").alias("survivor"), F.col("target").alias("least")), "survivors")
    n = state.count()
    steps = 1
    while True:
        nxt = state.select(F.col("source").alias("survivor"), F.col("survivor").alias("later"), F.col("least").alias("later_least"))
        moved = state.join(nxt, "survivor", "left")
        state = written(moved.select("source", F.coalesce("later", "survivor").alias("survivor"), F.least("least", F.coalesce("later_least", "least")).alias("least")), "survivors")
        steps *= 2
        open_rows = state.join(state.select(F.col("source").alias("survivor")), "survivor", "left_semi")
        if steps > n or open_rows.isEmpty():  # beyond n steps only cycles are open
            break
    in_cycle = state.select(F.col("source").alias("survivor"), F.col("least").alias("cycle"))
    return state.join(in_cycle, "survivor", "left").select("source", F.coalesce("cycle", "survivor").alias("survivor"))


def demo_merges(shop: Shop) -> DataFrame:
    """Customers whose id is a multiple of 10 merge into half their id, a chain at times; every
    third merge is undone later."""
    ids = shop.customers.filter("customer_id % 10 = 0 and customer_id > 0").select("customer_id")
    merged = ids.select(F.col("customer_id").alias("merge_id"), F.lit("merge").alias("event_type"), F.lit(1).alias("seq"), F.col("customer_id").alias("source"), F.floor(F.col("customer_id") / 2).alias("target"))
    undone = ids.filter("customer_id % 30 = 0").select(F.col("customer_id").alias("merge_id"), F.lit("undo").alias("event_type"), F.lit(2).alias("seq"), F.col("customer_id").alias("source"), F.floor(F.col("customer_id") / 2).alias("target"))
    return merged.unionByName(undone)


def merged_totals(shop: Shop) -> DataFrame:
    """Orders and spend by surviving customer after the active merges."""
    to = survivors(active_merges(demo_merges(shop)))
    rows = shop.orders.join(to, shop.orders["customer_id"] == to["source"], "left").select(F.coalesce("survivor", "customer_id").alias("customer_id"), "total")
    return rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("total"), 2).alias("spend"))


def matching(rows: DataFrame, columns: dict[str, Column], filters: dict[str, str], search: str = "") -> DataFrame:
    """Rows that hold each filter's text in its whitelisted column and the search in any of them."""
    unknown = [c for c in [*filters] if c not in columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    for name, needle in filters.items():
        rows = rows.filter(contains_ci(columns[name], needle))
    if search:
        any_of = F.lit(False)
        for column in columns.values():
            any_of = any_of | F.coalesce(contains_ci(column, search), F.lit(False))
        rows = rows.filter(any_of)
    return rows


def browse(rows: DataFrame, columns: dict[str, Column], sort: str, descending: bool, key: str | list[str], page: int, size: int, filters: dict[str, str], search: str = "") -> DataFrame:
    """A page of a table: ``matching`` rows in stable order."""
    keys = [key] if isinstance(key, str) else key
    by = columns.get(sort, columns[keys[0]])
    ordered = matching(rows, columns, filters, search).orderBy(by.desc_nulls_last() if descending else by.asc_nulls_first(), *[columns[k] for k in keys])
    return ordered.offset((page - 1) * size).limit(size)


def violations(shop: Shop) -> DataFrame:
    """Rows that break each table rule: checks, uniqueness and references."""
    lines = shop.raw("lineitem")
    rules = [
        ("lineitem.quantity > 0", lines.filter("l_quantity <= 0")),
        ("lineitem.price >= 0", lines.filter("l_extendedprice < 0")),
        ("lineitem key unique", lines.groupBy("l_orderkey", "l_linenumber").count().filter("count > 1")),
        ("lineitem.order exists", lines.join(shop.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("orders.customer exists", shop.orders.join(shop.customers, "customer_id", "left_anti")),
        ("orders.total >= 0", shop.orders.filter("total < 0")),
        ("customer.balance known", shop.raw("customer").filter("c_acctbal is null")),
    ]
    out = None
    for name, bad in rules:
        one = bad.agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("rule", "violations")


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two names, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def similar_names(shop: Shop, least: float = 0.7) -> DataFrame:
    """Pairs of different menu names of one type at the ratio or above; ``least`` is over 0.

    A ratio bounds the characters that two names share, and so their lengths. Candidates meet at one
    of a name's rarest characters (numbered by occurrence), of which the bound leaves so many that
    no pair is missed, and share enough characters; the ratio then decides.
    """
    low = least - 1e-6  # the ratio is rounded to six places
    names = shop.menu.select("type", "name").distinct().filter(F.length("name") > 0).withColumn("n", F.length("name"))
    chars = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.substr("name", i, F.lit(1)))
    numbered = F.transform("chars", lambda c, i: F.concat(c, F.size(F.filter(F.slice("chars", F.lit(1), i), lambda x: x == c)).cast("string")))
    names = names.withColumn("chars", chars).withColumn("chars", numbered)
    each = names.select("type", "name", "n", "chars", F.explode("chars").alias("char"))
    rare = each.join(each.groupBy("type", "char").agg(F.count(F.lit(1)).alias("names")), ["type", "char"])
    rank = F.row_number().over(Window.partitionBy("type", "name").orderBy("names", "char"))
    first = rare.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (low / (2 - low)) - 1e-9) + 1)
    a, b = first.alias("a"), first.alias("b")
    enough = F.size(F.array_intersect("a.chars", "b.chars")) >= (F.col("a.n") + F.col("b.n")) * (low / 2) - 1e-9
    pairs = a.join(b, (F.col("a.type") == F.col("b.type")) & (F.col("a.char") == F.col("b.char")) & (F.col("a.name") < F.col("b.name")) & enough)
    pairs = pairs.select(F.struct("a.type", "a.name").alias("a"), F.struct("b.name").alias("b")).distinct()
    scored = pairs.select(F.col("a.type").alias("type"), F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.round(name_ratio(F.col("a.name"), F.col("b.name")), 6).alias("ratio"))
    return scored.filter(F.col("ratio") >= least)


def best_matches(shop: Shop, least: float = 0.7) -> DataFrame:
    """The closest other name of its type for each menu name, if the ratio reaches ``least``."""
    pairs = similar_names(shop, least)
    both = pairs.unionByName(pairs.select("type", F.col("other").alias("name"), F.col("name").alias("other"), "ratio"))
    return both.groupBy("type", "name").agg(F.max(F.struct("ratio", "other")).alias("m")).select("type", "name", F.col("m.other").alias("match"), F.col("m.ratio").alias("ratio"))


def neighbours(shop: Shop, k: int = 6) -> DataFrame:
    """The k nearest menu names of each name by cosine of tf-idf of grams of 2 to 4 characters."""
    near = nearest(shop.menu.select(F.col("name").alias("id"), F.col("name").alias("text")).distinct(), k)
    return near.select(F.col("id").alias("name"), "other", "score", "rank")

"""The menu as a catalogue: variants, mappings of source ids, clustering, merges and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.functions.text import uuid5
from comanda.operators.entities import NAMESPACE, name_ratio
from comanda.sources.adapter import Shop


def variant_usage(shop: Shop) -> DataFrame:
    """Rows and quantities of each item's variants (null one of them) in items, add-ons and mappings."""
    lines = shop.variant_lines.groupBy("menu_item_id", "variant_id").agg(
        *[c for k in ("item", "addon") for c in (F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_rows"), F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("quantity"))), F.lit(0.0)).alias(f"{k}_quantity"))]
    )
    mapped = shop.mappings.groupBy("menu_item_id", "variant_id").agg(F.count(F.lit(1)).alias("mapping_rows"))
    both = lines.unionByName(mapped, allowMissingColumns=True).groupBy("menu_item_id", "variant_id")
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("item_rows", "addon_rows", "mapping_rows")], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("item_quantity", "addon_quantity")])


def unresolved(shop: Shop, suggestions: DataFrame) -> DataFrame:
    """Item variants with unverified mappings, their suggestion and use: ``suggestions(menu_item_id, suggestion_id)``."""
    open_rows = shop.mappings.filter(~F.col("is_verified")).groupBy("menu_item_id", "variant_id").agg(F.count(F.lit(1)).alias("open_mappings"))
    named = shop.variant_lines.join(shop.menu.select("menu_item_id", "name"), "menu_item_id")
    used = named.groupBy("menu_item_id", "variant_id").agg(F.min("name").alias("sample"), F.count(F.when(F.col("kind") == "item", 1)).alias("item_rows"), F.sum(F.when(F.col("kind") == "item", F.col("quantity")).otherwise(0.0)).alias("item_quantity"))
    other = shop.menu.select(F.col("menu_item_id").alias("suggestion_id"), F.col("name").alias("suggestion_name"), F.col("type").alias("suggestion_type"))
    rows = open_rows.join(shop.menu.select("menu_item_id", "name", "type"), "menu_item_id").join(suggestions, "menu_item_id", "left").join(other, "suggestion_id", "left")
    u = used.select(F.col("menu_item_id").alias("_item"), F.col("variant_id").alias("_variant"), "sample", "item_rows", "item_quantity")
    rows = rows.join(u, (F.col("menu_item_id") == F.col("_item")) & F.col("variant_id").eqNullSafe(F.col("_variant")), "left")
    return rows.select("menu_item_id", "name", "type", "suggestion_id", "suggestion_name", "suggestion_type", F.coalesce("variant_id", F.lit("UNKNOWN")).alias("variant"), "sample", "open_mappings", F.coalesce("item_rows", F.lit(0)).alias("item_rows"), F.coalesce("item_quantity", F.lit(0.0)).alias("item_quantity"))


def merge_impact(shop: Shop, pairs: DataFrame) -> DataFrame:
    """Lines, quantities, revenue and mappings that merging ``pairs(source, target)`` would move."""
    of = lambda k, x: F.sum(F.when(F.col("kind") == k, x).otherwise(0))
    lines = shop.sold.groupBy(F.col("menu_item_id").alias("source")).agg(of("item", 1).alias("item_rows"), of("addon", 1).alias("addon_rows"), F.sum("quantity").alias("quantity"), F.sum("total_price").alias("revenue"))
    mapped = shop.mappings.groupBy(F.col("menu_item_id").alias("source")).agg(F.count(F.lit(1)).alias("mapping_rows"))
    rows = pairs.join(lines, "source", "left").join(mapped, "source", "left")
    zero = lambda c, z: F.coalesce(F.col(c), F.lit(z)).alias(c)
    return rows.select("source", "target", zero("item_rows", 0), zero("addon_rows", 0), zero("mapping_rows", 0), zero("quantity", 0.0), F.round(F.coalesce("revenue", F.lit(0.0)), 2).alias("revenue"))


def active_moves(log: DataFrame) -> DataFrame:
    """The moves in force of a log (move_id, seq, event, source, variant, target, target_variant)."""
    last = log.groupBy("move_id").agg(F.max_by(F.struct("event", "source", "variant", "target", "target_variant"), "seq").alias("m"))
    return last.filter("m.event = 'merge'").select("m.source", "m.variant", "m.target", "m.target_variant")


def moved_lines(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Lines under the item and variant that the moves give them; a move without a variant is for all
    variants of its item and keeps them, one with a variant goes first."""
    by_variant = moves.filter("variant is not null").select(F.col("source").alias("menu_item_id"), F.col("variant").alias("variant_id"), F.col("target").alias("t1"), F.col("target_variant").alias("v1"))
    by_item = moves.filter("variant is null").select(F.col("source").alias("menu_item_id"), F.col("target").alias("t2"))
    rows = lines.join(by_variant, ["menu_item_id", "variant_id"], "left").join(by_item, "menu_item_id", "left")
    return rows.select(*[F.coalesce("t1", "t2", "menu_item_id").alias(c) if c == "menu_item_id" else F.when(F.col("t1").isNotNull(), F.col("v1")).otherwise(F.col("variant_id")).alias(c) if c == "variant_id" else F.col(c) for c in lines.columns])


def variants_cover(expected: DataFrame, asked: DataFrame, key: tuple[str, ...] = ("variant_id",)) -> DataFrame:
    """Variants of a merge's source (or of each source, by a longer ``key``) that its request lacks, does
    not have, or names twice."""
    key = list(key)
    missing = expected.join(asked, key, "left_anti").select(*key, F.lit("missing").alias("problem"))
    strange = asked.join(expected, key, "left_anti").select(*key, F.lit("unexpected").alias("problem")).distinct()
    twice = asked.groupBy(*key).count().filter("count > 1").select(*key, F.lit("duplicate").alias("problem"))
    return missing.unionByName(strange).unionByName(twice)


def clustered(incoming: DataFrame, mappings: DataFrame, menu: DataFrame) -> DataFrame:
    """``incoming(pos_id, name, type)`` with its menu item and how it was found: the mapping of its
    point-of-sale id, else an item of equal name and type, else a new one with its stable id."""
    same = menu.groupBy(F.lower(F.trim("name")).alias("n"), F.lower(F.trim("type")).alias("t")).agg(F.min("menu_item_id").alias("by_name"))
    known = mappings.groupBy("pos_id").agg(F.min("menu_item_id").alias("by_id"))
    rows = incoming.join(known, "pos_id", "left").join(same, (F.lower(F.trim("name")) == F.col("n")) & (F.lower(F.trim("type")) == F.col("t")), "left")
    new = uuid5(NAMESPACE, F.col("name"), F.col("type"))
    method = F.when(F.col("by_id").isNotNull(), "mapping").when(F.col("by_name").isNotNull(), "exact").otherwise("new")
    return rows.select("pos_id", "name", F.coalesce(F.col("by_id").cast("string"), F.col("by_name").cast("string"), new).alias("menu_item"), method.alias("method"))


def resolved(menu: DataFrame, edits: DataFrame) -> DataFrame:
    """The menu after edits (seq, menu_item_id, action, value): the last rename and type stand, verify
    marks an item, and remove takes it out unless it was verified later."""
    last = lambda a: F.max_by("value", F.when(F.col("action") == a, F.col("seq"))).alias(a)
    at = lambda a: F.max(F.when(F.col("action") == a, F.col("seq"))).alias(f"{a}_at")
    done = edits.groupBy("menu_item_id").agg(last("rename"), last("retype"), at("verify"), at("remove"))
    rows = menu.join(done, "menu_item_id", "left")
    stays = F.col("remove_at").isNull() | (F.coalesce("verify_at", F.lit(-1)) > F.col("remove_at"))
    return rows.filter(stays).select("menu_item_id", F.coalesce("rename", "name").alias("name"), F.coalesce("retype", "type").alias("type"), F.col("verify_at").isNotNull().alias("is_verified"))


def relinked(lines: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Lines without an item get that of ``snapshot(raw, menu_item_id)``; others keep theirs."""
    return lines.join(snapshot.select("raw", F.col("menu_item_id").alias("_item")), "raw", "left").withColumn("menu_item_id", F.coalesce("menu_item_id", "_item")).drop("_item")


def source_kind(in_items: Column, in_addons: Column) -> Column:
    return F.when(in_items & in_addons, "item+addon").when(in_items, "item").when(in_addons, "addon").otherwise("unknown")


def source_context(shop: Shop) -> DataFrame:
    """Each item's lines as item and add-on, the raw names among them, and where it is found."""
    named = shop.sold.join(shop.menu.select("menu_item_id", F.concat_ws(" ", "type", "name").alias("raw")), "menu_item_id")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    rows = named.groupBy("menu_item_id").agg(n("item").alias("item_rows"), n("addon").alias("addon_rows"), F.array_join(F.sort_array(F.collect_set("raw")), " | ").alias("raw_names"))
    return rows.withColumn("kind", source_kind(F.col("item_rows") > 0, F.col("addon_rows") > 0))


def cluster_review(shop: Shop) -> DataFrame:
    """Per item name and variant: mappings, different source ids and types, joined in order."""
    rows = shop.mappings.join(shop.menu.select("menu_item_id", "name", "type"), "menu_item_id")
    return rows.groupBy("name", "variant_id").agg(
        F.count(F.lit(1)).alias("mappings"), F.countDistinct("menu_item_id").alias("items"), F.countDistinct("type").alias("types"),
        F.array_join(F.sort_array(F.collect_set("type")), "|").alias("type_names"), F.min("pos_id").alias("first_pos_id"), F.count(F.when(F.col("is_verified"), 1)).alias("verified"),
    )


def cluster_problems(review: DataFrame) -> DataFrame:
    """Rows of a review that look wrong: a name in several types, or no mapping that was verified."""
    several = review.filter("types > 1").select("name", "variant_id", F.lit("several types").alias("problem"))
    return several.unionByName(review.filter("verified = 0").select("name", "variant_id", F.lit("nothing verified").alias("problem")))


def suspicious_merges(merges: DataFrame, least: float = 0.6) -> DataFrame:
    """``merges(merge_id, source_name, target_name, source_variant, target_variant)`` that look wrong: names
    whose ratio, case aside, is under ``least``, or a shift from one known size to another."""
    ratio = F.round(name_ratio(F.lower("source_name"), F.lower("target_name")), 6)
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("UNKNOWN", "1_PIECE")
    shift = known("source_variant") & known("target_variant") & (F.col("source_variant") != F.col("target_variant"))
    rows = merges.withColumn("ratio", ratio)
    problem = F.concat_ws(", ", F.when(F.col("ratio") < least, "names unlike"), F.when(shift, "variant shift"))
    return rows.withColumn("problem", problem).filter("problem <> ''")


def mapped_context(shop: Shop, asked: DataFrame) -> DataFrame:
    """``asked(source_id)`` with the mapping whose point-of-sale id or item id it is. The two keys meet
    in a join each; the first kind wins where both fit."""
    by_pos = asked.join(shop.mappings.select(F.col("pos_id").alias("source_id"), "menu_item_id", "variant_id", F.lit(0).alias("way")), "source_id")
    by_item = asked.join(shop.mappings.filter("variant_id is null").select(F.col("menu_item_id").alias("source_id"), "menu_item_id", "variant_id", F.lit(1).alias("way")), "source_id")
    first = F.row_number().over(Window.partitionBy("source_id").orderBy("way", "menu_item_id"))
    found = by_pos.unionByName(by_item).withColumn("r", first).filter("r = 1").drop("r", "way")
    return asked.join(found, "source_id", "left")

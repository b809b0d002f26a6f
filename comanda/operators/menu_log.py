"""The menu's log of merges, merges with variants, resolutions and undos: where lines stand at any position.

A log has rows (seq, merge_id, event, kind, source, variant, target, target_variant). ``event`` is merge or
undo; an undo needs seq and merge_id alone. ``kind`` says what a merge moves: ``item`` all lines of the item,
which keep their variants; ``variants`` the item's lines too, each variant by a row of its own with the same
seq and merge_id; ``resolution`` the lines of one variant, whose mappings count as verified from then on. A
null variant is a variant like others. Each seq and each merge_id is of one merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.session import written

_CELL = ("menu_item_id", "variant_id", "arrived")
_NEVER = 2**63 - 1


def _key(item: str, variant: str | None) -> Column:
    """What a step takes: all of an item, or one variant of it, null told apart from the empty name."""
    if variant is None:
        return F.struct(F.col(item).alias("item"), F.lit("all").alias("of"), F.lit("").alias("variant"))
    return F.struct(F.col(item).alias("item"), F.when(F.col(variant).isNull(), "none").otherwise("one").alias("of"), F.coalesce(variant, F.lit("")).alias("variant"))


def _steps(log: DataFrame) -> DataFrame:
    step = F.struct("seq", "merge_id", "kind", "target", "target_variant")
    return log.filter("event = 'merge'").select(F.when(F.col("kind") == "item", _key("source", None)).otherwise(_key("source", "variant")).alias("key"), "seq", step.alias("step"))


def _next_merge(cells: DataFrame, steps: DataFrame) -> DataFrame:
    """Each cell with the first step after ``at`` that takes it. Cells and steps of a key lie in one order
    and a running last value finds the step, so a key with many of both costs no pairs."""
    asks = cells.withColumn("cell", F.struct(*_CELL)).select("cell", F.col("at").alias("seq"), F.explode(F.array(_key("item", None), _key("item", "variant"))).alias("key"))
    rows = asks.unionByName(steps, allowMissingColumns=True)
    later = Window.partitionBy("key").orderBy(F.desc("seq"), F.col("step").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("step", F.last("step", ignorenulls=True).over(later)).filter("cell is not null and step is not null")
    return found.groupBy("cell").agg(F.min_by("step", "step.seq").alias("step")).select("cell.*", "step")


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join of cells, in which null variants are equal; the right side's key columns go."""
    named = right.select(*[F.col(c).alias(f"_{c}") if c in _CELL else F.col(c) for c in right.columns])
    on = (F.col("menu_item_id") == F.col("_menu_item_id")) & F.col("variant_id").eqNullSafe(F.col("_variant_id")) & (F.col("arrived") == F.col("_arrived"))
    return left.join(named, on, how).drop(*[f"_{c}" for c in _CELL])


def placements(cells: DataFrame, log: DataFrame) -> DataFrame:
    """Where lines of ``cells(menu_item_id, variant_id, arrived)`` stand: rows with item, variant, confirmed
    (a resolution holds), from_seq and to_seq (the first position at which it holds no more).

    ``arrived`` is the log position after which the lines came in; earlier events do not move them. An undo
    gives lines what its merge took from them, wherever they stand: a merge of kind ``item`` the item, others
    the variant too. Only the first undo of a merge, and only after it, counts. The lines of a merge undone
    amid a chain leave it; if a later merge is undone afterwards, they go where that one had found them.

    One round follows every chain by one event, so there are as many rounds as the longest chain has. Cells
    are of the menu and not of the sales. No cells: no rows. Rows with a null item never move.
    """
    steps = written(_steps(log), "steps")
    undos = written(log.filter("event = 'undo'").groupBy("merge_id").agg(F.collect_set("seq").alias("undos")), "undos")
    start = cells.select("menu_item_id", "variant_id", F.coalesce("arrived", F.lit(0)).cast("bigint").alias("arrived")).distinct()
    now = written(start.select(*_CELL, F.col("menu_item_id").alias("item"), F.col("variant_id").alias("variant"), F.lit(False).alias("confirmed"), F.col("arrived").alias("at")), "cells")
    back = now.select(*_CELL, F.lit("").alias("kind"), F.col("item").alias("old_item"), F.col("variant").alias("old_variant"), F.col("confirmed").alias("old_confirmed"), F.col("at").alias("undo_seq")).filter(F.lit(False))
    every = now
    while True:
        due = _same(back, now.select(*_CELL, "at"), "inner").filter(F.col("undo_seq") > F.col("at"))
        due = due.groupBy(*_CELL).agg(F.min(F.struct("undo_seq", "kind", "old_item", "old_variant", "old_confirmed")).alias("undo"))
        ahead = _same(_same(now, _next_merge(now, steps), "left"), due, "left").filter("step is not null or undo is not null")
        is_merge = F.col("step").isNotNull() & (F.col("undo").isNull() | (F.col("step.seq") < F.col("undo.undo_seq")))
        moved = written(ahead.withColumn("is_merge", is_merge), "moved")
        if moved.isEmpty():
            break
        pick = lambda step, undo: F.when(F.col("is_merge"), F.col(step)).otherwise(F.col(undo))
        variant = F.when(pick("step.kind", "undo.kind") == "item", F.col("variant")).otherwise(pick("step.target_variant", "undo.old_variant"))
        confirmed = F.when(F.col("is_merge"), F.col("confirmed") | (F.col("step.kind") == "resolution")).when(F.col("undo.kind") == "resolution", F.col("undo.old_confirmed")).otherwise(F.col("confirmed"))
        now = moved.select(*_CELL, pick("step.target", "undo.old_item").alias("item"), variant.alias("variant"), confirmed.alias("confirmed"), pick("step.seq", "undo.undo_seq").alias("at"))
        taken = moved.filter("is_merge").select(*_CELL, F.col("step.seq").alias("seq"), F.col("step.merge_id").alias("merge_id"), F.col("step.kind").alias("kind"), F.col("item").alias("old_item"), F.col("variant").alias("old_variant"), F.col("confirmed").alias("old_confirmed"))
        taken = taken.join(undos, "merge_id").withColumn("undo_seq", F.array_min(F.filter("undos", lambda u: u > F.col("seq"))))
        back = written(back.unionByName(taken.filter("undo_seq is not null").select(*back.columns)), "taken")
        every = every.unionByName(now)
    ends = F.lead("at", 1, _NEVER).over(Window.partitionBy(*_CELL).orderBy("at"))
    return written(every.select(*_CELL, "item", "variant", "confirmed", F.col("at").alias("from_seq"), ends.alias("to_seq")), "placements")


def placed(lines: DataFrame, places: DataFrame, at: int | None = None) -> DataFrame:
    """``lines(menu_item_id, variant_id, arrived, ...)`` under the item and variant that they have at log
    position ``at`` (null: after all of it), with ``confirmed``. Lines that came later stay as they came.
    Lines meet the moved cells alone, in one join whose side is of the menu's size."""
    at = _NEVER - 1 if at is None else at
    moved = places.filter((F.col("from_seq") <= at) & (F.col("to_seq") > at) & (F.col("from_seq") > F.col("arrived")))
    rows = _same(lines.withColumn("arrived", F.coalesce("arrived", F.lit(0)).cast("bigint")), moved.select(*_CELL, F.col("item").alias("_to"), F.col("variant").alias("_to_variant"), "confirmed"), "left")
    hit = F.col("_to").isNotNull()
    return rows.select(
        *[F.coalesce("_to", c).alias(c) if c == "menu_item_id" else F.when(hit, F.col("_to_variant")).otherwise(F.col(c)).alias(c) if c == "variant_id" else F.col(c) for c in lines.columns],
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"),
    )


def _deletions(log: DataFrame) -> DataFrame:
    """(item, seq, gone): merges that take an item off the menu and undos that bring it back."""
    merged = log.filter("event = 'merge' and kind <> 'resolution'").select("merge_id", "seq", F.col("source").alias("item")).distinct()
    undos = log.filter("event = 'undo'").select("merge_id", F.col("seq").alias("undo_seq"))
    back = merged.join(undos, "merge_id").filter("undo_seq > seq").groupBy("merge_id", "item").agg(F.min("undo_seq").alias("seq"))
    return merged.select("item", "seq", F.lit(True).alias("gone")).unionByName(back.select("item", "seq", F.lit(False).alias("gone")))


def menu_after(menu: DataFrame, log: DataFrame, at: int | None = None) -> DataFrame:
    """The menu at a log position: merged items are gone, and those that an undo brought back are verified."""
    upto = _deletions(log) if at is None else _deletions(log).filter(F.col("seq") <= at)
    last = upto.groupBy(F.col("item").alias("menu_item_id")).agg(F.max_by("gone", "seq").alias("_gone"))
    rows = menu.join(last, "menu_item_id", "left").filter("_gone is null or not _gone")
    return rows.withColumn("is_verified", F.col("is_verified") | F.col("_gone").isNotNull()).drop("_gone")


def log_problems(log: DataFrame, menu: DataFrame, expected: DataFrame) -> DataFrame:
    """merge_id, seq and problem of events that could not be done as the log stands: an item merged into
    itself, unknown items or ones that an earlier merge took away, an undo without an open merge, and a merge
    with variants that lacks some of the item's ``expected(menu_item_id, variant_id)`` or names one twice."""
    merges = log.filter("event = 'merge'")
    once = merges.groupBy("merge_id", "seq", "kind", "source", "target").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(_key("source", "variant")).alias("different"))
    tell = lambda rows, why: rows.select("merge_id", "seq", F.lit(why).alias("problem"))
    ends = once.select("merge_id", "seq", F.explode(F.array("source", "target")).alias("item")).distinct()
    unknown = ends.join(menu.select(F.col("menu_item_id").alias("item")), "item", "left_anti").select("merge_id", "seq").distinct()
    asks = ends.select("item", "seq", "merge_id", F.lit(None).cast("boolean").alias("gone")).unionByName(_deletions(log).withColumn("merge_id", F.lit(None).cast("bigint")))
    before = Window.partitionBy("item").orderBy("seq", F.col("merge_id").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    away = asks.withColumn("gone", F.last("gone", ignorenulls=True).over(before)).filter("merge_id is not null and gone").select("merge_id", "seq").distinct()
    first = once.groupBy("merge_id").agg(F.min("seq").alias("merged"))
    undos = log.filter("event = 'undo'").select("merge_id", "seq").join(first, "merge_id", "left")
    nth = F.row_number().over(Window.partitionBy("merge_id", F.col("seq") > F.col("merged")).orderBy("seq"))
    closed = undos.withColumn("n", nth).filter("merged is null or seq < merged or n > 1")
    mapped = merges.filter("kind = 'variants'")
    have = expected.select(F.col("menu_item_id").alias("source"), F.col("variant_id").alias("variant")).distinct()
    need = mapped.select("merge_id", "seq", "source").distinct().join(have, "source").select("merge_id", "seq", _key("source", "variant").alias("key"))
    given = mapped.select("merge_id", "seq", _key("source", "variant").alias("key"))
    lacks = need.join(given, ["merge_id", "seq", "key"], "left_anti").select("merge_id", "seq").distinct()
    strange = given.join(need, ["merge_id", "seq", "key"], "left_anti").select("merge_id", "seq").distinct()
    rows = tell(once.filter("source = target and kind <> 'resolution'"), "same item").unionByName(tell(unknown, "unknown item")).unionByName(tell(away, "item merged before")).unionByName(tell(closed, "no open merge"))
    return rows.unionByName(tell(lacks, "variant missing")).unionByName(tell(strange, "variant unknown")).unionByName(tell(once.filter("kind = 'variants' and rows > different"), "variant twice"))


def resolution_state(menu: DataFrame, mappings: DataFrame, lines: DataFrame, touched: DataFrame) -> DataFrame:
    """The ``touched(menu_item_id)`` items of the menu and what becomes of each: ``deleted`` without mappings and
    lines, ``verified`` without mappings but sold, or with all mappings verified, else ``open``."""
    items = touched.select("menu_item_id").distinct().join(menu.select("menu_item_id"), "menu_item_id")
    mapped = mappings.groupBy("menu_item_id").agg(F.count(F.lit(1)).alias("mapping_rows"), F.count(F.when(~F.col("is_verified"), 1)).alias("open_rows"))
    used = lines.groupBy("menu_item_id").agg(F.count(F.lit(1)).alias("line_rows"))
    rows = items.join(mapped, "menu_item_id", "left").join(used, "menu_item_id", "left").na.fill(0, ["mapping_rows", "open_rows", "line_rows"])
    state = F.when((F.col("mapping_rows") == 0) & (F.col("line_rows") == 0), "deleted").when(F.col("open_rows") == 0, "verified").otherwise("open")
    return rows.withColumn("state", state)


def after_resolution(menu: DataFrame, states: DataFrame) -> DataFrame:
    """The menu with ``states``: deleted items out, others verified or open; untouched ones as they were."""
    rows = menu.join(states.select("menu_item_id", "state"), "menu_item_id", "left").filter("state is null or state <> 'deleted'")
    return rows.withColumn("is_verified", F.when(F.col("state").isNull(), F.col("is_verified")).otherwise(F.col("state") == "verified")).drop("state")


def variant_move_counts(moves: DataFrame, variants: DataFrame, mappings: DataFrame, lines: DataFrame) -> DataFrame:
    """``moves(menu_item_id, variant_id, new_variant_id)`` with the mappings, lines and add-ons that each would
    move, and its status: ``moved``, or why not. Volume forecasts are stale (``clears_volume``) where rows move."""
    cell = ["menu_item_id", "variant_id"]
    mapped = mappings.filter("variant_id is not null").groupBy(*cell).agg(F.count(F.lit(1)).alias("mapping_rows"))
    sold = lines.filter("variant_id is not null").groupBy(*cell).agg(F.count(F.when(F.col("kind") == "item", 1)).alias("item_rows"), F.count(F.when(F.col("kind") == "addon", 1)).alias("addon_rows"))
    known = lambda c, name: variants.select(F.col("variant_id").alias(c), F.lit(True).alias(name)).distinct()
    rows = moves.join(mapped, cell, "left").join(sold, cell, "left").na.fill(0, ["mapping_rows", "item_rows", "addon_rows"])
    rows = rows.join(known("variant_id", "_old"), "variant_id", "left").join(known("new_variant_id", "_new"), "new_variant_id", "left")
    nothing = F.col("mapping_rows") + F.col("item_rows") + F.col("addon_rows") == 0
    status = F.when(F.col("variant_id") == F.col("new_variant_id"), "same variant").when(F.col("_old").isNull() | F.col("_new").isNull(), "unknown variant").when(nothing, "nothing to move").otherwise("moved")
    return rows.select(*moves.columns, "mapping_rows", "item_rows", "addon_rows", status.alias("status"), (status == "moved").alias("clears_volume"))

"""The menu log against doing its events one by one, and what it refuses."""

import random

import pytest
from pyspark.sql import functions as F

from comanda.operators import menu_log

LOG = "seq bigint, merge_id bigint, event string, kind string, source bigint, variant string, target bigint, target_variant string"
VARIANTS = (None, "", "v1", "v2")


def one_by_one(lines, log, at=None):
    """Each line's (item, variant, confirmed) after the events up to ``at``: every event touches every line."""
    state = {k: (item, variant, False) for k, (item, variant, _) in enumerate(lines)}
    taken = {}
    for seq in sorted({e[0] for e in log}):
        rows = [e for e in log if e[0] == seq]
        if at is not None and seq > at:
            break
        if rows[0][2] == "undo":
            for k, (kind, old) in taken.pop(rows[0][1], {}).items():
                item, variant, confirmed = state[k]
                state[k] = (old[0], variant if kind == "item" else old[1], old[2] if kind == "resolution" else confirmed)
            continue
        had = taken.setdefault(rows[0][1], {})
        for k, now in list(state.items()):
            if lines[k][2] is not None and lines[k][2] >= seq:
                continue
            for _, _, _, kind, source, variant, target, target_variant in rows:
                if now[0] == source and (kind == "item" or now[1] == variant):
                    had[k] = (kind, now)
                    state[k] = (target, now[1] if kind == "item" else target_variant, now[2] or kind == "resolution")
                    break
    return state


def random_log(r, n, items=7):
    log, open_ = [], []
    for seq in range(1, n + 1):
        if open_ and r.random() < 0.35:
            log.append((seq, open_.pop(r.randrange(len(open_))), "undo", None, None, None, None, None))
            continue
        kind, source, target = r.choice(("item", "variants", "resolution")), r.randrange(items), r.randrange(items)
        open_.append(100 + seq)
        for v in VARIANTS if kind == "variants" else [r.choice(VARIANTS)]:
            log.append((seq, 100 + seq, "merge", kind, source, None if kind == "item" else v, target, None if kind == "item" else r.choice(VARIANTS)))
    return log


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_places_equal_one_by_one_at_every_position(spark, seed):
    r = random.Random(seed)
    log = random_log(r, 14)
    lines = [(i, v, p) for i in range(7) for v in VARIANTS for p in (None, 0, 5, 9)]
    frame = spark.createDataFrame([(k, *line) for k, line in enumerate(lines)], "line int, menu_item_id bigint, variant_id string, arrived bigint")
    places = menu_log.placements(frame, spark.createDataFrame(log, LOG))
    for at in (None, 14, 10, 6, 3, 0):
        got = {x.line: (x.menu_item_id, x.variant_id, x.confirmed) for x in menu_log.placed(frame, places, at).collect()}
        assert got == one_by_one(lines, log, at), at


def test_an_inner_link_is_undone(spark):
    log = [(1, 1, "merge", "item", 1, None, 2, None), (2, 2, "merge", "item", 2, None, 3, None), (3, 1, "undo", None, None, None, None, None), (3 + 1, 1, "undo", None, None, None, None, None)]
    lines = spark.createDataFrame([(1, "v1", 0), (2, None, 0), (1, "v1", 9), (None, None, 0)], "menu_item_id bigint, variant_id string, arrived bigint")
    places = menu_log.placements(lines, spark.createDataFrame(log, LOG))
    at = lambda p: [(r.menu_item_id, r.variant_id) for r in menu_log.placed(lines, places, p).orderBy("arrived", "menu_item_id").collect()]
    assert sorted(map(str, at(2))) == sorted(map(str, [(3, "v1"), (3, None), (1, "v1"), (None, None)]))
    assert sorted(map(str, at(None))) == sorted(map(str, [(1, "v1"), (3, None), (1, "v1"), (None, None)]))
    assert menu_log.placements(lines.limit(0), spark.createDataFrame(log, LOG)).count() == 0
    assert menu_log.placements(lines, spark.createDataFrame([], LOG)).count() == 4


def test_menu_after_merges_and_undos(spark):
    menu = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", False)], "menu_item_id bigint, name string, is_verified boolean")
    log = spark.createDataFrame([(1, 1, "merge", "item", 1, None, 2, None), (2, 2, "merge", "resolution", 3, "v1", 2, "v1"), (3, 1, "undo", None, None, None, None, None)], LOG)
    after = lambda at: {r.menu_item_id: r.is_verified for r in menu_log.menu_after(menu, log, at).collect()}
    assert after(0) == {1: False, 2: False, 3: False} and after(2) == {2: False, 3: False} and after(None) == {1: True, 2: False, 3: False}


def test_problems(spark):
    menu = spark.createDataFrame([(i,) for i in range(1, 9)], "menu_item_id bigint")
    expected = spark.createDataFrame([(5, None), (5, "v1"), (6, "v1")], "menu_item_id bigint, variant_id string")
    m = lambda seq, kind, s, v, t: (seq, seq, "merge", kind, s, v, t, "v1")
    u = lambda seq, of: (seq, of, "undo", None, None, None, None, None)
    log = [
        m(1, "item", 1, None, 1), m(2, "item", 1, None, 99), m(3, "item", 2, None, 3), m(4, "item", 2, None, 4), m(5, "item", 4, None, 2), u(6, 3), m(7, "resolution", 2, "v1", 4), u(8, 3), u(9, 77), u(10, 20),
        m(11, "variants", 5, "v1", 3), m(11, "variants", 5, "v1", 3), m(12, "variants", 6, "v1", 3), m(12, "variants", 6, "v9", 3), m(13, "resolution", 7, "v1", 7), m(20, "item", 8, None, 7),
    ]
    got = {(r.merge_id, r.seq, r.problem) for r in menu_log.log_problems(spark.createDataFrame(log, LOG), menu, expected).collect()}
    assert got == {
        (1, 1, "same item"), (2, 2, "unknown item"), (2, 2, "item merged before"), (4, 4, "item merged before"), (5, 5, "item merged before"), (7, 7, "item merged before"), (3, 8, "no open merge"), (77, 9, "no open merge"),
        (20, 10, "no open merge"), (11, 11, "variant missing"), (11, 11, "variant twice"), (12, 12, "variant unknown"),
    }


def test_resolution_state(spark):
    menu = spark.createDataFrame([(i, True) for i in range(1, 6)], "menu_item_id bigint, is_verified boolean")
    mappings = spark.createDataFrame([(1, True), (1, False), (2, True)], "menu_item_id bigint, is_verified boolean")
    lines = spark.createDataFrame([(3,), (1,)], "menu_item_id bigint")
    states = menu_log.resolution_state(menu, mappings, lines, menu.filter("menu_item_id < 5").unionByName(menu.limit(1)))
    assert {r.menu_item_id: r.state for r in states.collect()} == {1: "open", 2: "verified", 3: "verified", 4: "deleted"}
    assert {r.menu_item_id: r.is_verified for r in menu_log.after_resolution(menu, states).collect()} == {1: False, 2: True, 3: True, 5: True}


def test_variant_moves(spark):
    moves = spark.createDataFrame([(1, "a", "b"), (1, "a", "a"), (1, "a", "z"), (2, "a", "b"), (2, "b", "a")], "menu_item_id bigint, variant_id string, new_variant_id string")
    variants = spark.createDataFrame([("a",), ("b",)], "variant_id string")
    mappings = spark.createDataFrame([(1, "a"), (1, None)], "menu_item_id bigint, variant_id string")
    lines = spark.createDataFrame([(1, "a", "item"), (2, "b", "addon")], "menu_item_id bigint, variant_id string, kind string")
    got = {(r.menu_item_id, r.variant_id, r.new_variant_id): (r.mapping_rows, r.item_rows, r.addon_rows, r.status) for r in menu_log.variant_move_counts(moves, variants, mappings, lines).collect()}
    assert got == {(1, "a", "b"): (1, 1, 0, "moved"), (1, "a", "a"): (1, 1, 0, "same variant"), (1, "a", "z"): (1, 1, 0, "unknown variant"), (2, "a", "b"): (0, 0, 0, "nothing to move"), (2, "b", "a"): (0, 0, 1, "moved")}
    assert menu_log.variant_move_counts(moves, variants, mappings, lines).filter(F.col("clears_volume")).count() == 2

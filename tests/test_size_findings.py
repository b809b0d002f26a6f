"""What only larger tables showed: halves in binary, ids that meet, blocks of pairs."""

import datetime as dt

import duckdb

import __spark_entry__ as entry


def _folder(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _sql(folder, tables, query, columns):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[query]})").fetchall())


def _said(spark, folder, query):
    got = entry.queries()[query](spark, folder)
    return sorted(map(tuple, got.collect())), got.columns


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
CUSTOMERS = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ALL = ("orders", "lineitem", "part", "customer", "events")


def _shop(spark, tmp_path, **own):
    empty = {"orders": ([], ORDERS), "lineitem": ([], LINES), "part": ([], PARTS), "customer": ([], CUSTOMERS), "events": ([], EVENTS)}
    return _folder(spark, tmp_path, **(empty | own))


def test_money_labels_round_binary_halves(spark, tmp_path):
    day = dt.datetime(1998, 2, 6)
    folder = _shop(spark, tmp_path, orders=([(71409, 1, "F", 7661.5, day, "5-LOW"), (1, 1, "F", 1150.0, day, "5-LOW"), (4, 1, "F", 105000.0, day, "5-LOW")], ORDERS))
    got, columns = _said(spark, folder, "X17_money_labels")
    assert got == _sql(folder, ALL, "X17_money_labels", columns)
    assert (71409, "76", "₹76.61") in got


def test_clustered_items_of_a_menu_beyond_a_million(spark, tmp_path):
    keys = [1, 2, 5, 1_000_000, 1_000_001]  # 10 x 1,000,000 + 1 is 1 + 10,000,000
    folder = _shop(spark, tmp_path, part=([(k, f"part {k}", "B", "LARGE", 1, 1.0) for k in keys], PARTS))
    got, columns = _said(spark, folder, "E4_clustered_items")
    assert [r[1] for r in got if r[0] == 10_000_001] == ["exact", "mapping"]


def test_texts_of_two_blocks_hand_on_k_rows_each(monkeypatch):
    import numpy as np
    import pandas as pd

    from comanda.operators import cosine

    monkeypatch.setattr(cosine, "STRIP", 50)
    rng = np.random.default_rng(1)
    w = np.where(rng.random((90, 30)) < np.linspace(0.02, 1, 30), rng.integers(1, 3, (90, 30)), 0).astype(float)
    frame = pd.DataFrame({"id": rng.permutation(90), "g": [np.nonzero(x)[0] for x in w], "w": [x[x > 0] for x in w]})
    got = cosine._best(frame[:40], frame, 3)
    assert got.groupby("id").size().max() == 3  # pairs of a block are never rows
    for i, x in zip(frame["id"][:40], w[:40], strict=True):
        every = sorted((-s, j) for s, j in zip(w @ x, frame["id"], strict=True) if j != i and s > 0)
        mine = got[got["id"] == i]
        assert sorted(zip(-mine["score"], mine["other"], strict=True)) == every[:3]


def test_larger_tables_make_more_tasks_with_the_same_rows(spark, monkeypatch):
    from comanda import session
    from comanda.sources.adapter import Shop

    folder = "/root/testdata/sf0.001"
    names = ("A36_menu_stats", "A36_menu_stats_filtered", "E9_top_items", "E9_recent_orders")
    want = {n: _said(spark, folder, n) for n in names}
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    n = Shop(spark, folder).n_lines
    assert session.spread(spark.range(9), n, "id").rdd.getNumPartitions() == -(-n // 500) > 4
    for name in names:
        df = entry.queries()[name](spark, folder)
        assert "hashpartitioning(order_id" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {-(-n // 500)})" in plan
        assert (sorted(map(tuple, df.collect())), df.columns) == want[name]


def test_feed_is_made_in_tasks_by_size_and_read_in_part(spark, monkeypatch):
    from comanda import session
    from comanda.sources import payloads
    from comanda.sources.adapter import Shop

    monkeypatch.setattr(session, "TASK_ROWS", 500)
    shop = Shop(spark, "/root/testdata/sf0.001")
    feed = payloads.order_feed(shop)
    assert feed.rdd.getNumPartitions() == -(-shop.n_lines // 500)
    brief, whole = payloads.opened(feed, brief=True), payloads.opened(feed)
    assert set(brief.columns) < set(whole.columns) and brief.schema["Order"].dataType.names == ["orderID", "created_on", "total"]
    key = lambda rows: sorted(map(tuple, rows.select("order_id", "stream_id", "event_id", "created_on", "Order.total", "Customer.name").collect()))
    assert key(brief) == key(whole)


def test_blocks_of_texts_are_read_and_not_shuffled_to_each_other(spark, monkeypatch):
    from comanda.operators import cosine

    texts = spark.createDataFrame([(i, f"person {i * 7 % 50} street {i % 9}") for i in range(120)] + [(120, None), (121, "")], "id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(cosine.nearest(texts, 3))
    asked = texts.filter("id % 10 = 0")
    want_asked = rows(cosine.nearest(texts, 3, asked))
    assert want_asked == [r for r in want if r[0] % 10 == 0] and len(want) == 360
    monkeypatch.setattr(cosine, "BLOCK", 5)  # 25 blocks
    many = cosine.nearest(texts, 3)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1  # what is ranked
    assert rows(many) == want and rows(cosine.nearest(texts, 3, asked)) == want_asked


def test_features_of_a_larger_panel_are_made_and_kept_in_more_tasks(spark, monkeypatch):
    from comanda import session
    from comanda.operators import panel
    from comanda.plans.base import NOW
    from comanda.sources.adapter import Shop

    rows = session.written(panel.panel(Shop(spark, "/root/testdata/sf0.001"), *NOW), "panel")
    monkeypatch.setattr(session, "TASK_ROWS", rows.count() // 12)
    got = panel.written_features(rows)
    assert len(got.inputFiles()) > 6  # shuffles have 4, and bytes alone would make 1
    shown = lambda df: sorted((r["menu_item_id"], r["day"], *(round(r[c], 9) for c in panel.FEATURES)) for r in df.collect())
    assert shown(got) == shown(panel.features(rows, True)) and got.columns == panel.features(rows, True).columns


def test_items_are_not_dealt_by_category_for_the_next_day(spark):
    from comanda.operators import demand

    state = spark.createDataFrame([(i, "AB"[i % 2], 1.0, 1.0, "1998-01-01", [1.0, 2.0]) for i in range(6)], "menu_item_id long, category string, price double, item_median_price double, first_day string, recent array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = demand.next_features(state, "1998-01-03", 25.0, 0.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan

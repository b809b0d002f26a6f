"""Registered queries against their oracle SQL, and golden and edge cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from comanda.functions.text import uuid5
from comanda.operators import entities, insights
from comanda.plans import catalog
from comanda.sources.adapter import Shop
from comanda.streaming import incremental

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(value(r[k]) for k in at) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_uuid5_equals_the_standard_library(spark):
    import uuid

    got = spark.createDataFrame([(" Cold Coffee", "Drink ")], "a string, b string").select(uuid5(entities.NAMESPACE, F.col("a"), F.col("b"))).first()[0]
    assert got == str(uuid.uuid5(entities.NAMESPACE, "cold coffee:drink"))


def all_similar(rows, least=0.7):
    from difflib import SequenceMatcher

    ratio = lambda a, b: round(SequenceMatcher(None, a, b).ratio(), 6)
    rows = sorted({(t, n) for t, n in rows if t is not None and n is not None})
    return sorted((t, a, b, ratio(a, b)) for t, a in rows for u, b in rows if t == u and a < b and ratio(a, b) >= least)


def test_similar_names_equal_all_pairs(spark):
    import random
    from types import SimpleNamespace

    rng = random.Random(8)
    names = ["cold coffee", "old coffee", "iced coffee", "coffee cold", "aab", "baa", "Äpfel", "äpfel", "\U0001f354 bun", "\U0001f355 bun", "x" * 250, "y" + "x" * 249, "", None]
    names += ["".join(rng.choices("abcd ", k=rng.randint(1, 14))) for _ in range(120)]
    rows = [(t, n) for k, n in enumerate(names) for t in ("Drink", "Food", None)[: 1 + k % 3]]
    menu = spark.createDataFrame(rows + rows[:9], "type string, name string")
    for least in (0.5, 0.7, 1.0):
        got = sorted(tuple(r) for r in entities.similar_names(SimpleNamespace(menu=menu), least).collect())
        assert got == all_similar(rows, least)
    shop = Shop(spark, FOLDER)
    got = sorted(tuple(r) for r in entities.similar_names(shop).collect())
    assert got == all_similar([tuple(r) for r in shop.menu.select("type", "name").collect()])
    assert any(a[0] != b[0] for _, a, b, _ in got)


def test_popular_queries_are_whole_texts_of_users(spark):
    from types import SimpleNamespace

    long = "what were the sales of "
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", long + "May"), (1, 3, "user", long + "June"), (2, 0, "system", "be brief"), (2, 2, "assistant", "none"), (2, 5, "user", long + "June"), (3, 0, "user", ""), (3, 1, "user", None), (4, 1, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = insights.popular_queries(SimpleNamespace(raw=lambda name: table)).collect()
    assert [tuple(r) for r in got] == [(long + "June", 2, 2), ("x", 1, 4), (long + "May", 1, 1)]


def test_merge_then_undo_restores(spark):
    log = spark.createDataFrame([(1, "merge", 1, 5, 4), (2, "merge", 2, 4, 3), (1, "undo", 3, 5, 4)], "merge_id int, event_type string, seq int, source int, target int")
    active = entities.active_merges(log)
    assert [tuple(r) for r in active.collect()] == [(2, 4, 3)]
    chain = entities.survivors(log.filter("event_type = 'merge'").select("merge_id", "source", "target"))
    assert {tuple(r) for r in chain.collect()} == {(5, 3), (4, 3)}


def test_browse_refuses_unknown_columns(spark):
    with pytest.raises(ValueError):
        entities.browse(spark.range(3), {"id": F.col("id")}, "id", False, "id", 1, 2, {"other": "x"})


def test_only_reading_sql(spark):
    with pytest.raises(ValueError):
        incremental.read_only_sql(Shop(spark, FOLDER), "DROP TABLE x")


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = incremental.daily_windows(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {tuple(r) for r in spark.table("days").collect()}
    want = {tuple(r) for r in incremental.daily_windows(events).collect()}
    assert got and got <= want
    assert {r[0] for r in want} - {r[0] for r in got} <= {max(r[0] for r in want)}  # the open day is withheld


def test_upsert_stream_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        incremental.upsert_stream(source, str(tmp_path / "out"), ["k"], "v", str(tmp_path / "check")).awaitTermination()
    got = incremental.latest(spark.read.parquet(str(tmp_path / "out")), ["k"], "v").select("k", "x")
    assert {tuple(r) for r in got.collect()} == {(1, "b"), (2, "c")}

"""Versioned tables and the customers that a feed keeps up to date: replays, killed writes, cleared versions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from comanda.session import scratch
from comanda.sources import payloads
from comanda.sources.adapter import Shop
from comanda.streaming.customers import Customers
from comanda.streaming.versions import Table, upsert_stream

FOLDER = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, buckets=4):
    return Table.create(spark, scratch(spark, "table"), "k bigint, v bigint, x string", ["k"], buckets)


def of(spark, values):
    return spark.createDataFrame(values, "k bigint, v bigint, x string")


def test_versions_and_cleared_files(spark):
    t = table(spark)
    assert rows(t.read()) == [] and t.head().version == 0
    t.upsert(of(spark, [(1, 1, "a"), (2, 1, "b"), (1, 3, "c"), (None, 1, "n")]), "v")
    t.upsert(of(spark, [(1, 2, "late"), (2, 5, "d"), (3, 1, None), (None, 2, "m")]), "v")
    assert rows(t.read(1)) == rows(of(spark, [(1, 3, "c"), (2, 1, "b"), (None, 1, "n")]))
    assert rows(t.read()) == rows(of(spark, [(1, 3, "c"), (2, 5, "d"), (3, 1, None), (None, 2, "m")]))
    t.change(of(spark, [(3, 0, None)]), lambda old, gone: old.join(gone, "k", "left_anti"))  # a bucket may become empty
    left = rows(t.read())
    assert left == rows(of(spark, [(1, 3, "c"), (2, 5, "d"), (None, 2, "m")]))
    data = Path(t.folder.removeprefix("file://")) / "data"
    before = sum(1 for _ in data.rglob("*.parquet"))
    t.vacuum()
    assert rows(t.read()) == left and t.versions() == [3] and sum(1 for _ in data.rglob("*.parquet")) < before
    with pytest.raises(ValueError, match="no version 1"):
        t.read(1)
    t.change(of(spark, []), lambda old, new: old)
    assert rows(t.read()) == left
    assert Table.create(spark, t.folder, "k bigint, v bigint, x string", ["k"]).head().version == 4


def test_untouched_buckets_keep_their_files(spark):
    t = table(spark, buckets=64)
    t.upsert(of(spark, [(k, 1, "a") for k in range(200)]), "v")
    old = t.head().paths
    t.upsert(of(spark, [(7, 2, "b")]), "v")
    assert sum(p != old[b] for b, p in t.head().paths.items()) == 1


def test_killed_write_leaves_the_version_before(spark, monkeypatch):
    t = table(spark)
    t.upsert(of(spark, [(1, 1, "a")]), "v", mark=0)
    with monkeypatch.context() as m:
        m.setattr(Table, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.upsert(of(spark, [(1, 2, "b")]), "v", mark=1)
    (Path(t.folder.removeprefix("file://")) / "versions/version=2/_temporary").mkdir(parents=True)  # killed while the entry was written
    assert rows(t.read()) == [(1, 1, "a")] and t.head().mark == 0
    t.upsert(of(spark, [(1, 2, "b")]), "v", mark=1)
    t.upsert(of(spark, [(1, 9, "again")]), "v", mark=1)
    assert rows(t.read()) == [(1, 2, "b")]


def test_stream_into_versions(spark, tmp_path):
    t, source = table(spark), str(tmp_path / "in")
    for values in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")], [(1, 1, "a"), (3, 1, "d")]):
        of(spark, values).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k bigint, v bigint, x string").parquet(source)
        upsert_stream(stream, t, "v", str(tmp_path / "checkpoint")).awaitTermination()
    assert rows(t.read()) == [(1, 2, "c"), (2, 1, "b"), (3, 1, "d")] and t.head().version == 3


def event(stream_id, order_id, total, day, event_id="walk-in", name="Walk In", phone=None, address=None):
    customer = {"name": name, "phone": phone, "address": address}
    inner = {"Order": {"orderID": order_id, "created_on": f"2024-02-{day:02} 10:00:00", "total": total}, "Customer": customer}
    return (json.dumps({"stream_id": stream_id, "event_id": event_id, "raw_event": {"raw_payload": {"properties": inner}}}),)


def feed(spark, *events):
    return spark.createDataFrame(list(events), "payload string")


def test_verified_by_hand_is_not_demoted(spark):
    c = Customers.open(spark, scratch(spark, "customers"), 2)
    c.ingest(feed(spark, event(1, 1, 10.0, 1)))
    assert not c.customers.read().first().is_verified
    c.verify(c.customers.read())
    c.ingest(feed(spark, event(2, 2, 15.0, 2)))
    row = c.customers.read().first()
    assert (row.is_verified, row.total_orders, row.total_spent, str(row.last_order)) == (True, 2, 25.0, "2024-02-02 10:00:00")


def test_replays_late_and_moved_orders(spark):
    c = Customers.open(spark, scratch(spark, "customers"), 2)
    first = feed(spark, event(1, 1, 10.0, 1, name=" ", address="A"), event(2, 2, 5.0, 2, name="B", phone="+91 9876543210"))
    c.ingest(first, 0)
    before = rows(c.customers.read())
    assert {r[1] for r in before} == {"Anonymous", "B"}
    c.ingest(first, 0)  # the batch again
    c.ingest(first, 1)  # its events again in another batch
    assert rows(c.customers.read()) == before
    c.ingest(feed(spark, event(4, 1, 12.0, 3, name="Late", phone="98765 43210", address="C"), ("no document",)), 2)  # the order now has a phone
    (row,) = c.customers.read().collect()
    assert (row.name, row.phone, row.address, row.total_orders, row.total_spent) == ("B", "+91 9876543210", "C", 2, 17.0)
    c.ingest(feed(spark, event(3, 1, 99.0, 3)), 3)  # older than what is known
    assert rows(c.customers.read()) == [tuple(row)]


def test_broken_off_between_the_tables(spark, monkeypatch):
    c = Customers.open(spark, scratch(spark, "customers"), 2)
    batch = feed(spark, event(1, 1, 10.0, 1))
    with monkeypatch.context() as m:
        m.setattr(Table, "upsert", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            c.ingest(batch, 0)
    c.ingest(batch, 0)
    assert c.customers.read().first().total_orders == 1 and c.orders.read().count() == 1


def test_survivors_get_the_orders(spark):
    c = Customers.open(spark, scratch(spark, "customers"), 2)
    c.ingest(feed(spark, event(1, 1, 10.0, 1)))
    key = c.customers.read().first().identity_key
    c.ingest(feed(spark, event(2, 2, 5.0, 1)), survivors=spark.createDataFrame([(key, "phone:x")], "identity_key string, survivor string"))
    assert {(r.identity_key, r.total_orders) for r in c.customers.read().collect()} == {(key, 1), ("phone:x", 1)}


def test_batches_equal_the_whole_feed(spark, tmp_path):
    whole = payloads.order_feed(Shop(spark, FOLDER))
    c, source = Customers.open(spark, scratch(spark, "customers"), 4), str(tmp_path / "feed")
    for batch in ("stream_id < 1000", "stream_id % 3 = 0", "stream_id >= 1000"):
        whole.filter(batch).select("payload").write.mode("append").parquet(source)
        c.follow(spark.readStream.schema("payload string").parquet(source), str(tmp_path / "checkpoint")).awaitTermination()
    shown = lambda df: rows(df.select("identity_key", "name", "first_order", "last_order", "total_orders", F.round("total_spent", 2), "is_verified"))
    assert shown(c.customers.read()) == shown(payloads.customers_of(whole))

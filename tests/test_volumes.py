"""Volumes of items in units of all kinds, their scales, and demand from quantiles of targets."""

from pyspark.sql import functions as F

from comanda.operators import panel


def test_volumes_and_scales(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 0.0), (2, 3.0), (3, 0.0), (4, 5.0), (5, 1.0)], "menu_item_id bigint, q double")
    menu = spark.createDataFrame([(1, "kg", 2), (2, "mg", 1), (3, "g", 5), (4, "g", None)], "menu_item_id bigint, unit string, unit_value int")
    volumes = panel.volume_panel(rows, menu)
    assert sorted((r.menu_item_id, round(r.q, 6)) for r in volumes.collect()) == [(1, 0.0), (1, 4000.0), (1, 8000.0), (2, 0.003), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert {r.menu_item_id: round(r.scale, 6) for r in panel.volume_scales(volumes).collect()} == {1: 6000.0, 2: 0.003, 3: 1.0, 4: 1.0, 5: 1.0}


def test_demand_in_volumes(spark):
    rows = spark.createDataFrame([(0.5, 1.0, 2.0, 100.0), (1.0, 2.0, 1.0, 10.0), (0.25, -1.0, -2.0, 8.0)], "p double, a double, b double, s double")
    got = [tuple(r.d) for r in rows.select(panel.volume_demand(*map(F.col, "pabs")).alias("d")).collect()]
    assert got == [(50.0, 100.0, 85), (20.0, 20.0, 20), (0.0, 0.0, 0)]

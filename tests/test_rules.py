"""Golden and edge cases of the analytics operators, against brute force where SQL cannot tell."""

import math
from datetime import datetime
from difflib import SequenceMatcher
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from comanda.functions import scalars
from comanda.operators import catalogue, cosine, customers, demand, entities, loyalty, panel, people, quantiles
from comanda.plans import things
from comanda.plans.base import NOW
from comanda.session import written
from comanda.sources import files, payloads
from comanda.sources.adapter import Shop
from comanda.streaming import incremental, tables

FOLDER = "/root/testdata/sf0.001"


def test_filters_refuse_nonsense():
    for bad in ({"start": "2024-02-01", "end": "2024-01-01"}, {"back_start": "2024-01-02", "back_end": "2024-01-01"}, {"back_days": 0}, {"min_orders": 0}):
        with pytest.raises(ValueError):
            loyalty.Filters(**({"start": "2024-01-01", "end": "2024-01-31"} | bad))
    f = loyalty.Filters("2024-03-01", "2024-03-31", back_days=30, min_orders=1)
    assert f.lookback == ("2024-01-31", "2024-02-29")
    with pytest.raises(ValueError):
        f.repeated("a rate")
    assert loyalty.normalized_sources([" a ", "", None, "All", "b", "a"]) == ("a", "b") and loyalty.normalized_sources(["all"]) == ()


def test_trends_refuse_months(spark):
    for months in (0, 25):
        with pytest.raises(ValueError):
            loyalty.repeat_trend(Shop(spark, FOLDER), "1998-03-15", months)


def test_rates_refuse_thresholds_that_tell_no_repeat(spark):
    shop = Shop(spark, FOLDER)
    for call in (lambda: customers.return_rate(shop, NOW, NOW, 1), lambda: customers.repeat_rate(shop, NOW, 1), lambda: customers.return_analysis(shop, NOW, NOW, 1)):
        with pytest.raises(ValueError):
            call()


def test_open_lookback_makes_everybody_returning(spark):
    shop = Shop(spark, FOLDER)
    row = loyalty.return_summary(shop, loyalty.Filters(*NOW)).first()
    assert row["customers"] == row["returning"] > 0


def test_affinity_edges(spark):
    gaps = [(None, "New"), (0, "Repeat"), (60, "Repeat"), (61, "Lapsed"), (364, "Lapsed"), (365, "New")]
    rows = spark.createDataFrame([(g, s) for g, s in gaps], "gap int, want string").withColumn("got", loyalty._segment(F.col("gap")))
    assert all(r["want"] == r["got"] for r in rows.collect())


def test_customer_estimate(spark):
    rows = spark.createDataFrame([(10, 5, 5), (0, 8, 0), (0, 0, 0)], "v int, u int, c int")
    low, high = loyalty.customer_estimate(F.col("v"), F.col("u"), F.col("c"))
    got = [tuple(r) for r in rows.select(low, high).collect()]
    assert got == [(round(5 + 5 / 2.0), round(5 + 5 / 1.6)), (8, 10), (0, 0)]


def test_merge_policy(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False), (None, None)], "s boolean, t boolean")
    got = [r[0] for r in rows.select(entities.merge_policy(F.col("s"), F.col("t"))).collect()]
    assert got == ["verified_pair", "error", "into_verified_target", "unverified_pair", "unverified_pair"]


def test_long_chains_and_cycles_have_survivors(spark):
    chain = [(k, k, k + 1) for k in range(100)]
    ring = [(200 + k, 200 + k, 200 + (k + 1) % 5) for k in range(5)] + [(300, 300, 203)]
    got = {r["source"]: r["survivor"] for r in entities.survivors(spark.createDataFrame(chain + ring, "merge_id int, source int, target int")).collect()}
    assert all(got[k] == 100 for k in range(100)) and {got[200 + k] for k in range(5)} == {200} and got[300] == 200
    assert entities.survivors(spark.createDataFrame([], "merge_id int, source int, target int")).count() == 0


@pytest.mark.parametrize("query", ["DROP TABLE x", "WITH t AS (SELECT 1 AS x) INSERT INTO y SELECT x FROM t", "INSERT INTO y VALUES (1)", "CREATE TABLE z AS SELECT 1", "SELECT 1; DROP TABLE x", "", "FROM orders_view INSERT INTO y SELECT *", "SET a = b"])
def test_only_queries_are_run(spark, query):
    with pytest.raises(ValueError):
        incremental.read_only_sql(Shop(spark, FOLDER), query)


def test_queries_are_run(spark):
    shop = Shop(spark, FOLDER)
    assert incremental.read_only_sql(shop, "WITH t AS (SELECT 1 AS x) SELECT * FROM t -- done", 5).first()[0] == 1
    assert incremental.read_only_sql(shop, "SELECT order_id FROM orders_view ORDER BY order_id;", 2).count() == 2
    assert incremental.read_only_sql(shop, "DESCRIBE orders_view").count() > 3


def test_times_of_all_formats(spark):
    cases = [("2024-03-01 10:00:00", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00.5", "2024-03-01 10:00:00.5"), ("2024-03-01T10:00:00Z", "2024-03-01 15:30:00"), ("2024-03-01T10:00:00.250+0530", "2024-03-01 10:00:00.25"), ("2024-03-01T23:00:00+00:00", "2024-03-02 04:30:00"), ("1 March", None), ("", None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want string").select(scalars.parsed_time(F.col("t")).cast("string").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_labels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalars.indian_grouping(F.lit(x))) for x in (7, 999, 1000, 123456, 1234567890)] == ["7", "999", "1,000", "1,23,456", "1,23,45,67,890"]
    assert [one(scalars.hour_label(F.lit(h))) for h in (0, 1, 12, 13, 24)] == ["12 AM", "1 AM", "12 PM", "1 PM", "12 AM"]
    assert [one(scalars.chart_label(F.lit(x))) for x in (999.0, 1500.0, 250000.0, 12500000.0)] == ["₹999.0", "₹1.5K", "₹2.5L", "₹1.3Cr"]
    assert one(scalars.header_label(F.lit("variant_id_total_kpi"))) == "Variant ID Total KPI"
    assert [one(scalars.rain_category(F.lit(x))) for x in (0.5, 0.6, 2.5)] == ["none", "drizzle", "heavy"]
    assert one(scalars.number_of(F.lit("inf"))) is None and one(scalars.number_of(F.lit(" 2 "))) == 2.0
    assert scalars.is_effectively_empty(spark.createDataFrame([], "a int")).first()[0] and not scalars.is_effectively_empty(spark.range(1)).first()[0]


def plain_similarity(a, b):
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x and y else 0.0
    wa, wb = a.split(), b.split()
    if not wa or not wb:
        return 0.0
    full = ratio(a, b)
    base = full
    if len(wa) > 1 or len(wb) > 1:
        base = 0.35 * ratio(" ".join(sorted(wa)), " ".join(sorted(wb))) + 0.25 * ratio(wa[0], wb[0]) + 0.2 * full
        base += 0.2 * (ratio(wa[-1], wb[-1]) if len(wa) > 1 and len(wb) > 1 else full)
    sure = 0.75 + 0.25 * (min(max(len(wa), len(wb)), 3) / 3 * 0.6 + min(max(sum(map(len, wa)), sum(map(len, wb))), 12) / 12 * 0.4)
    return min(1.0, base * sure)


def test_name_similarity_equals_its_definition(spark):
    names = ["john", "john smith", "smith john", "jon smyth", "anna maria de souza", "", "ana maria souza", "x"]
    rows = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string").withColumn("s", people.name_similarity(F.col("a"), F.col("b")))
    assert all(math.isclose(r["s"], plain_similarity(r["a"], r["b"]), abs_tol=1e-9) for r in rows.collect())


def plain_neighbours(texts, k):
    """Cosine of tf-idf grams of all pairs."""
    from collections import Counter

    grams = {i: Counter(f" {w} "[a : a + n] for w in (t or "").lower().split() for n in (2, 3, 4) for a in range(len(w) + 3 - n)) for i, t in texts}
    df = Counter(g for c in grams.values() for g in c)
    w = {i: {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in grams.items()}
    w = {i: {g: x / math.sqrt(sum(y * y for y in v.values())) for g, x in v.items()} for i, v in w.items()}
    out = {}
    for i, a in w.items():
        scores = sorted((-round(sum(x * b[g] for g, x in a.items() if g in b), 5), j) for j, b in w.items() if j != i and not a.keys().isdisjoint(b))
        out[i] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_equals_all_pairs(spark, monkeypatch, k):
    import random

    monkeypatch.setattr(cosine, "BLOCK", 8)
    rng = random.Random(k)
    words = ["customer#0000", "maria", "mario", "smith", "smythe", "house", "city", "flat", "x", "yz"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", "1", "22", "333"]) for _ in range(rng.randrange(1, 6)))) for i in range(160)]
    texts += [(200, texts[0][1]), (201, texts[0][1]), (202, ""), (203, None), (204, "qqq"), (205, "the customer#0000")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {}
    for r in cosine.nearest(df, k).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["other"], r["score"]))
    want = {i: x for i, x in plain_neighbours(texts, k).items() if x}
    assert got.keys() == want.keys() and all([s for _, s in got[i]] == pytest.approx([s for _, s in want[i]], abs=2e-5) for i in want)
    assert sum(got[i] != want[i] for i in want) <= 2  # scores that round apart by one place
    asked = cosine.nearest(df, k, spark.createDataFrame([(3,), (202,)], "id long")).orderBy("rank").collect()
    assert [(r["id"], r["other"]) for r in asked] == [(3, j) for j, _ in got[3]]


def test_similar_customers_equal_all_pairs(spark):
    shop = Shop(spark, FOLDER)
    merges = shop.customers.filter("customer_id % 25 = 0").select("customer_id").selectExpr("customer_id as source", "customer_id - 1 as target")
    known = {r["customer_id"]: r["r"] for r in people.records(shop).collect() if r["customer_id"] % 25}
    near = plain_neighbours([(i, r["text"]) for i, r in known.items()], people.NEIGHBOURS)
    pairs = [(i, j, s) for i, x in near.items() for j, s in x] + [(i, j, None) for i, a in known.items() for j, b in known.items() if i < j and a["phone"] and a["phone"] == b["phone"]]
    scored = people.pair_scores(shop, spark.createDataFrame(pairs, "customer_id long, other_id long, cosine double")).filter("kept").collect()
    best = {}
    for r in scored:
        key = tuple(sorted((r["customer_id"], r["other_id"])))
        best[key] = max(best.get(key, 0.0), r["score"])
    got = people.similar_customers(shop, merges, limit=10**6).collect()
    assert {tuple(sorted((r["source"], r["target"]))): pytest.approx(r["score"], abs=1e-3) for r in got} == best and len(got) == len(best) > 10
    verified = {r["customer_id"]: r["is_verified"] for r in shop.customers.collect()}
    assert not any(verified[r["source"]] and not verified[r["target"]] for r in got)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    few = people.similar_customers(shop, merges, "000000003", 10**6).collect()
    name = {i: r["name"] for i, r in known.items()}
    assert few and all("000000003" in name[r["source"]] or "000000003" in name[r["target"]] for r in few)


def test_pair_scores_keep_phone_pairs(spark):
    shop = Shop(spark, FOLDER)
    rows = people.pair_scores(shop, people.same_phone_pairs(shop)).collect()
    assert rows and all(r["kept"] and 0.88 <= r["score"] <= 0.99 and "Exact phone match" in r["reasons"] for r in rows)


def test_best_matches_equal_all_pairs(spark):
    shop = Shop(spark, FOLDER)
    names = sorted({(r[0], r[1]) for r in shop.menu.select("type", "name").collect()})
    want = {}
    for t, a in names:
        close = [(round(SequenceMatcher(None, *sorted((a, b))).ratio(), 6), b) for u, b in names if t == u and a != b]
        best = max([c for c in close if c[0] >= 0.7], default=None)
        if best:
            want[t, a] = best
    got = {(r["type"], r["name"]): (r["ratio"], r["match"]) for r in entities.best_matches(shop).collect()}
    assert got == want


@pytest.fixture(scope="module")
def demand_model(spark):
    shop = Shop(spark, FOLDER)
    rows = written(panel.panel(shop, "1997-07-01", "1998-03-31").drop("first"), "panel")
    training = written(panel.features(rows, training=True), "training")
    return rows, training, demand.trained(training)


def test_demand_models(spark, demand_model):
    rows, training, model = demand_model
    said = model.predicted(training)
    bad = said.filter("p90 < p50 or p50 < 0 or probability < 0 or probability > 1")
    assert bad.count() == 0 and said.count() == training.count()
    assert panel.forecast_metrics(said).first()["auc"] > 0.6
    late = demand.held_out(training)
    days = sorted(r[0] for r in training.select("day").distinct().collect())
    assert late.agg(F.min("day")).first()[0] == days[int(len(days) * 0.8)]
    assert 0.8 <= panel.forecast_metrics(late).first()["p90_coverage"] <= 1.0
    # the demand of all items and days is about what they sold, not what they sell if they sell
    both = demand.combined(said).agg(F.avg("q"), F.avg("p50"), F.avg("p90")).first()
    assert both[1] < 2 * both[0] and both[1] <= both[2]


def test_forecast_follows_the_features(spark, demand_model):
    """The carried state gives the features of a replayed day, and a day of the forecast is the next one's history."""
    rows, _, model = demand_model
    end = F.lit("1998-03-30").cast("date")
    weather = tuple(rows.filter(F.col("day") == F.date_add(end, 1)).select("temperature", "rain").first())
    said = demand.forecast(rows.filter(F.col("day") <= end), model, "1998-03-30", 3, weather).collect()
    by = {(r["menu_item_id"], str(r["day"])): r for r in said}
    history = rows.filter(F.col("day") <= end)
    for day in ("1998-03-31", "1998-04-01", "1998-04-02"):
        last = history.groupBy("menu_item_id").agg(F.max_by("category", "day").alias("category"), F.max_by("price", "day").alias("price"))
        coming = last.select("menu_item_id", "category", "price", F.lit(day).cast("date").alias("day"), F.lit(0.0).alias("q"), F.lit(weather[0]).alias("temperature"), F.lit(weather[1]).alias("rain"))
        want = demand.combined(model.predicted(panel.features(history.unionByName(coming.select(*history.columns))).filter(F.col("day") == F.lit(day).cast("date")))).collect()
        assert len(want) == sum(k[1] == day for k in by)
        for r in want:
            got = by[r["menu_item_id"], day]
            assert all(abs(got[c] - r[c]) < 1e-6 for c in ("probability", "p50", "p90")) and got["prep"] == r["prep"]
        fed = spark.createDataFrame([(k[0], float(round(r["p50"]))) for k, r in by.items() if k[1] == day], "menu_item_id long, fed double")
        history = written(history.unionByName(coming.join(fed, "menu_item_id").select("menu_item_id", "category", "price", "day", F.col("fed").alias("q"), "temperature", "rain").select(*history.columns)), "history")


def test_demand_of_one_class(spark):
    rows = spark.createDataFrame([(k, f"1998-01-{d:02d}", 5.0 + k) for k in range(6) for d in range(1, 9)], "menu_item_id long, day string, q double").withColumn("day", F.to_date("day"))
    rows = rows.select("*", *[F.lit(1.0).alias(c) for c in panel.FEATURES])
    model = demand.trained(rows)
    assert model.classifier is None
    got = demand.combined(model.predicted(rows).withColumn("probability", F.lit(0.25)))
    assert {(r["p50"], r["p90"], r["prep"]) for r in got.collect()} == {(0.25 * 7, 0.25 * 10, 3)}


def test_folds_read_no_later_day(spark, demand_model, monkeypatch):
    _, training, model = demand_model
    seen = []
    monkeypatch.setattr(demand, "trained", lambda rows: seen.append(str(rows.agg(F.max("day")).first()[0])) or model)
    done = spark.createDataFrame([("1998-03-02",)], "day string").withColumn("day", F.to_date("day"))
    got = demand.by_folds(training, ["1998-03-09", "1998-03-02", "1998-02-10"], done)
    assert {str(r["day"]) for r in got.select("day").distinct().collect()} == {"1998-02-10", "1998-03-09"}
    assert seen == ["1998-02-09", "1998-03-08"] and got.filter("p90 < p50").count() == 0


def test_boosted_quantiles(spark):
    """On later rows the loss is below that of a constant and of one tree, and the 90th percentile holds."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    x = [F.rand(k) for k in range(3)]
    rows = spark.range(8000).select("id", *[c.alias(f"f{k}") for k, c in enumerate(x)])
    rows = written(rows.withColumn("y", 20 * F.col("f0") + F.when(F.col("f1") > 0.6, 15).otherwise(0) + F.abs(F.randn(5)) * (2 + 8 * F.col("f2"))), "rows")
    train, test = rows.filter("id % 4 <> 3"), rows.filter("id % 4 = 3")
    names = ["f0", "f1", "f2"]
    model = quantiles.fitted(train, "y", names)
    said = test.withColumn("p50", model.predicted(0)).withColumn("p90", model.predicted(1))
    vector = VectorAssembler(inputCols=names, outputCol="v")
    tree = DecisionTreeRegressor(featuresCol="v", labelCol="y", maxDepth=4, leafCol="leaf").fit(vector.transform(train))
    leaves = tree.transform(vector.transform(train)).groupBy("leaf").agg(F.percentile("y", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
    one = tree.transform(vector.transform(test)).join(leaves, "leaf").select("y", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"))
    flat = train.agg(F.percentile("y", F.array(F.lit(0.5), F.lit(0.9)))).first()[0]
    for k, (name, share) in enumerate((("p50", 0.5), ("p90", 0.9))):
        loss = quantiles.pinball(said, "y", name, share)
        assert loss < quantiles.pinball(one, "y", name, share) and loss < 0.7 * quantiles.pinball(test.withColumn("c", F.lit(flat[k])), "y", "c", share)
    assert 0.85 <= said.agg(F.avg((F.col("y") <= F.col("p90")).cast("int"))).first()[0] <= 0.95


def test_weather_fills_forward_then_back(spark):
    from comanda.operators import series

    day = lambda k: datetime(2024, 1, k).date()
    weather = spark.createDataFrame([(day(3), 20.0), (day(6), 30.0)], "day date, temp_max double")
    orders = spark.createDataFrame([(day(2), datetime(2024, 1, 2, 9), 5.0)], "business_date date, created_on timestamp_ntz, total double")
    shop = SimpleNamespace(weather=weather, success=orders, spark=spark)
    got = [(r["day"][-1], r["revenue"], r["temp_max"]) for r in series.revenue_with_weather(shop, "2024-01-01", "2024-01-07").orderBy("day").collect()]
    assert got == [("1", 0.0, 20.0), ("2", 5.0, 20.0), ("3", 0.0, 20.0), ("4", 0.0, 20.0), ("5", 0.0, 20.0), ("6", 0.0, 30.0), ("7", 0.0, 30.0)]


def test_order_file(spark, tmp_path):
    event = '{"stream_id": 4, "event_id": "a", "occurred_at": "2024-03-01 10:00:00", "raw_event": {"raw_payload": {"properties": {"Order": {"orderID": 9, "created_on": "", "total": 12.5, "order_from": "Web", "status": "Success"}, "Customer": {"name": "Ann", "phone": "+91 98765 43210"}, "Restaurant": {"restID": "r", "res_name": "R"}, "OrderItem": [{"itemid": 1, "quantity": 2, "price": 3, "total": 6, "addon": [{"itemid": 7, "quantity": 1, "price": 1, "total": 1}]}, {"itemid": 2, "quantity": 1, "price": 5, "total": 5}], "Tax": [{"title": "CGST", "rate": 2.5, "amount": 0.3}], "Discount": []}}}}'
    (tmp_path / "orders.json").write_text(f"[{event}, {event.replace(': 4,', ': 3,').replace('12.5', '11')}]")
    read = files.read_json_array(spark, str(tmp_path / "orders.json"), payloads.EVENT)
    feed = read.select(F.to_json(F.struct("*")).alias("payload")).unionByName(spark.createDataFrame([("broken {",), (None,)], "payload string"))
    got = {k: v.collect() for k, v in payloads.tables(feed).items()}
    assert [(r["order_id"], r["total"], str(r["created_on"])) for r in got["orders"]] == [(9, 12.5, "2024-03-01 10:00:00")]
    assert sorted(r["position"] for r in got["items"]) == [0, 1] and [r["menu_item_id"] for r in got["addons"]] == [7] and len(got["taxes"]) == 1 and not got["discounts"]
    assert payloads.customers_of(feed).first()["is_verified"]


def test_batches_drain_once(spark):
    rows, sent = spark.range(10).select(F.col("id").alias("k")), spark.range(3).select(F.col("id").alias("k"))
    seen = []
    while True:
        batch = [r[0] for r in tables.next_batch(rows, sent, ["k"], "k", 3).collect()]
        if not batch:
            break
        seen += batch
        sent = tables.marked_sent(sent, spark.createDataFrame([(k,) for k in batch], "k long"), ["k"])
    assert seen == list(range(3, 10))


def test_pages_without_failure_move_the_cursor(spark):
    rows = spark.createDataFrame([(k, True) for k in range(1, 8)], "seq long, ok boolean")
    assert {r["next_cursor"] for r in tables.replay_page(rows, 2, 3).collect()} == {5}
    assert all(r["applies"] for r in tables.replay_page(rows, 2, 3).collect())


def test_moves_and_browser_refuse_unknown(spark):
    shop = Shop(spark, FOLDER)
    lines = spark.createDataFrame([(1, "v1"), (1, None), (2, "v1")], "menu_item_id int, variant_id string")
    moves = spark.createDataFrame([(1, "v1", 9, None), (1, None, 8, None)], "source int, variant string, target int, target_variant string")
    assert sorted(map(repr, catalogue.moved_lines(lines, moves).collect())) == sorted(map(repr, spark.createDataFrame([(9, None), (8, None), (2, "v1")], "menu_item_id int, variant_id string").collect()))
    for call in (lambda: things.browse_table(shop, "users"), lambda: things.browse_table(shop, "orders", filters={"secret": "x"})):
        with pytest.raises(ValueError):
            call()


def test_feed_is_read_by_cursor(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from comanda.sources.feed import CursorFeed

    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q["cursor"])
            if len(asked) == 2:  # one failure is tried again
                self.send_error(503)
                return
            ids = [k for k in range(1, 1201) if k > q["cursor"]][: q["limit"]]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"stream_id": k, "event_id": f"e{k}"} for k in ids]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(CursorFeed)
    options = {"url": f"http://127.0.0.1:{server.server_port}/orders", "limit": "900", "retry_wait": "0.01", "page_wait": "0"}
    rows = spark.read.format("cursor_feed").options(**options).load().collect()
    assert [r["stream_id"] for r in rows] == list(range(1, 1201)) and asked == [0, 500, 500, 1000]
    some = spark.read.format("cursor_feed").options(**options, start="1100", max_records="30").load()
    assert [r["stream_id"] for r in some.collect()] == list(range(1101, 1131))

    def pull():
        query = spark.readStream.format("cursor_feed").options(**options).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()

    pull()
    pull()  # the cursor is in the checkpoint, so nothing comes twice
    got = sorted(r["stream_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    server.shutdown()
    assert got == list(range(1, 1201))


def test_pull_begins_anew_without_customers(spark):
    loaded, some = spark.range(5).select(F.col("id").alias("k")), spark.range(1)
    assert incremental.start_cursor(loaded, "k", some).first()[0] == 4
    assert incremental.start_cursor(loaded, "k", some.limit(0)).first()[0] == 0
    assert incremental.start_cursor(loaded.limit(0), "k", some).first()[0] == 0

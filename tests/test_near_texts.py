"""Nearest texts: few pairs are scored, and none that counts is left out."""

import random

import numpy as np
import pandas as pd
import pytest

from comanda.operators import cosine


def _block(texts, low, k):
    """Texts as one block, and the rows of all pairs."""
    codes, row, _, _ = cosine.tallied([t for _, t in texts])
    _, df = np.unique(cosine.tallied([t for _, t in texts])[2], return_counts=True)
    v = cosine.Vectors.of([t for _, t in texts], len(texts), codes, df)
    parts = {"low": low, "ends": v.ends.astype(np.int64), "g": cosine._small(v.g), "tf": cosine._small(v.tf), "codes": v.codes, "df": v.df}
    row = {"id": [i for i, _ in texts]} | {c: p.tobytes() for c, p in parts.items()}
    part = lambda x: pd.Series(np.split(x, v.ends[1:-1]), dtype=object)
    frame = pd.DataFrame({"id": row["id"], "g": part(v.g), "w": part(v.w)})
    return {f"{side}_{c}": x for side in "ab" for c, x in row.items()}, cosine._best(frame, frame, k)


def _rows(frame):
    return sorted(map(tuple, frame.round(5).to_numpy().tolist()))


@pytest.mark.parametrize("bound", ["none", "some", "kth"])
def test_few_pairs_are_scored_and_none_is_missed(bound, monkeypatch):
    monkeypatch.setattr(cosine, "PRODUCTS", 5_000)
    rng = random.Random(3)
    texts = [(i, f"customer#{i:09d} | 98{i - i % 6:08d} | house {i % 90}, city {rng.randrange(25)}") for i in range(1_500)]
    row, every = _block(texts, np.zeros(len(texts)), 5)
    kth = every.groupby("id")["score"].min().to_numpy()
    low = {"none": kth * 0, "some": kth * 0.9, "kth": kth}[bound]
    row["a_low"] = row["b_low"] = low.tobytes()
    meeting = cosine._Meeting(cosine.Block(len(texts), row, "a"), cosine.Block(len(texts), row, "b"))
    scored, scores = [], meeting.scores
    meeting.scores = lambda i, j: scored.append(len(i)) or scores(i, j)
    assert _rows(meeting.best(5)) == _rows(every)
    if bound == "kth":  # a product of all pairs made 2,250,000
        assert sum(scored) < len(texts) ** 2 / 20


def test_counts_of_many_grams_are_joined_with_the_same_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = ["maria", "mario", "smith", "smythe", "Ünal", "straße", "x", "𝒳𝒴 z", "東京都", "a\tb"]
    texts = [(f"id {i}", " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 5)))) for i in range(150)]
    texts += [(f"same {i}", "one text of many") for i in range(40)] + [("none", None), ("gap", " \t "), ("alone", "qqqqq")]
    df = spark.createDataFrame(texts, "id string, text string")
    rows = lambda: sorted(map(tuple, cosine.nearest(df, 4).collect()))
    want = rows()
    assert [r[1] for r in sorted(r for r in want if r[0] == "same 7")] != [] and {r[1] for r in want if r[0] == "same 7"} == {"same 0", "same 1", "same 10", "same 11"}
    assert not {"none", "gap", "alone"} & {x for r in want for x in r[:2]}
    monkeypatch.setattr(cosine, "SENT", 0)
    monkeypatch.setattr(cosine, "BLOCK", 20)
    monkeypatch.setattr(cosine, "WINDOW", 16)
    assert rows() == want


def test_only_pairs_that_may_be_suggested_are_scored(spark, monkeypatch):
    from comanda.operators import people
    from comanda.sources.adapter import Shop

    shop = Shop(spark, "/root/testdata/sf0.001")
    merges = shop.customers.filter("customer_id % 25 = 0").select("customer_id").selectExpr("customer_id as source", "customer_id - 1 as target")
    counts, scores = [], people.pair_scores
    monkeypatch.setattr(people, "FIRST", 20)

    def counted(shop, pairs, *args, at_most=False, **more):
        if not at_most:
            counts.append(pairs.count())
        return scores(shop, pairs, *args, at_most=at_most, **more)

    monkeypatch.setattr(people, "pair_scores", counted)
    few = people.similar_customers(shop, merges, limit=5).collect()
    first, second = counts
    every = people.similar_customers(shop, merges, limit=10**6).collect()
    assert few == every[:5] and len(few) == 5
    assert first <= 20 and first + second < counts[2] / 2  # all were scored before

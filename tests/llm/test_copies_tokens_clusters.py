"""Exact deduplication, alignment of tokens and ball k-means against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from comanda.llm import ball_kmeans, exact_dedup, token_alignment
from comanda.llm.queries import ALIGNED

DOCS = "doc_id long, text string"


def copies(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((i is not None, i or 0, -k, i))
    out = []
    for t, members in groups.items():
        keep = max(members)
        sha = hashlib.sha256(t.encode()).hexdigest()
        out += [(m[3], keep[3], len(members), m == keep, sha) for m in members]
    return sorted(out, key=repr)


@pytest.mark.parametrize("share", [1 << 14, 16])
def test_exact_dedup(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "SHARE", share)  # 16: copies of 30 rows in 400 and more are heavy
    rng = random.Random(3)
    rows = [(k, rng.choice(["hot", "hot", "warm", f"text {rng.randrange(60)}", " hot", "Hot"])) for k in range(400)]
    rows += [(None, "hot"), (None, "lone"), (None, None), (7, ""), (7, ""), (7, None), (399, rows[399][1]), (1000, "x" * 100_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = exact_dedup.judged(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == copies(rows)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_exact_dedup_heavy_are_found(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, F.concat(F.lit("b"), F.col("id") % 700)).otherwise(F.col("id").cast("string")).alias("text"), F.col("id").alias("doc_id"))
    ranked = rows.select(exact_dedup.digest(F.col("text")).alias("_digest"), F.struct(F.col("doc_id").alias("id")).alias("_rank"))
    found = exact_dedup.heavy_digests(ranked).collect()
    assert len(found) == 701 and max(r["_n"] for r in found) == 6667


def test_exact_dedup_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y"), (2, "a", 6, "y"), (3, None, 7, "z"), (4, "", 8, "w")], "doc_id long, text string, kept long, _digest string")
    assert sorted(map(tuple, exact_dedup.deduplicated(df).collect())) == [(2, "a", 6, "y"), (4, "", 8, "w")]
    assert exact_dedup.deduplicated(df.limit(0)).collect() == [] and exact_dedup.judged(df.limit(0)).collect() == []


ODD = [
    "", None, " ", "   ", "a", " a", "a ", "a  b", "a\nb", "a\n b", "a\n  b", "a \n\n  b\t\tc", "\tx", "\n\n", "x y", "x   y", " z", "it's we'll DON'T", "<|endoftext|> and <s> </s> <unk> <0x41>", "café é ﬁn",
    "你好世界", "\U0001f600\U0001f600 ok", "a▁b", "▁", "x\x00y", "x\x1cy \x85 z", "﻿bom", "привет, мир! 12345 6", "a" * 3000, "1 2  3   4    5     6", "　　w", "x᠎ y", "a​ b", "tab\there  \t  end  ", "\r\n\r\nline\r\n",
]


def plain_tokens(both, text):
    """Ids and bytes by encoding the whole text, or none."""
    if not text:
        return [], []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(both.bytes_a[k] for k in a) != whole or b"".join(both.bytes_b[k] for k in b) != whole:
        return [], []
    return a, b


def alignments(both, texts):
    """Row by row: groups from offsets, links from overlapping ranges."""
    found = []
    for text in texts:
        a, b = plain_tokens(both, text)
        ends = lambda ids, table: np.cumsum([len(table[k]) for k in ids]).tolist()
        ea, eb = ends(a, both.bytes_a), ends(b, both.bytes_b)
        cuts = sorted(set(ea) & set(eb))
        groups = [([x for x, e in zip(a, ea, strict=True) if s < e <= t], [x for x, e in zip(b, eb, strict=True) if s < e <= t]) for s, t in zip([0, *cuts], cuts, strict=False)]
        links = [(x, y) for x, e, s in zip(a, ea, [0, *ea], strict=False) for y, f, r in zip(b, eb, [0, *eb], strict=False) if max(s, r) < min(e, f)]
        found.append((a, b, groups, links))
    counts = Counter(p for *_, links in found for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for a, b, groups, links in found:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(line.encode()).hexdigest() if line else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return out


def test_units_are_whole_texts():
    both = token_alignment.tokenizers(*ALIGNED)[0]
    rng = random.Random(5)
    marks = ["a", "Z", "word", " ", "  ", "\n", "\t", " ", " ", " ", "'s", ".", "!?", "9", "я", "é", "́", "中", "\U0001f60a", "　", "-", "_", "\x0b", "\r\n", "▁", "\x1f"]
    texts = [x for x in ODD if x] + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    for text, (a, b) in zip(texts, both.of_texts(texts), strict=True):
        assert (np.frombuffer(a, "<i4").tolist(), np.frombuffer(b, "<i4").tolist()) == plain_tokens(both, text), repr(text)


@pytest.mark.parametrize("hot_share", [token_alignment.HOT, 50, 1])
def test_token_alignment(spark, monkeypatch, hot_share):
    monkeypatch.setattr(token_alignment, "SLICE", 500)
    rng = random.Random(1)
    words = ["alpha", "beta", "running", "Donaudampf", "the", "of", "unbelievable", "tokenizers", "x1y2", "...", "дом"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(60)] + ["same text here"] * 3
    rows = list(enumerate(texts)) + [(None, "alpha beta"), (1, "alpha beta")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string").repartition(3)
    want = alignments(token_alignment.tokenizers(*ALIGNED)[0], [t for _, t in rows])
    got = token_alignment.alignment(df, *ALIGNED, hot_share)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=repr)


def test_token_alignment_empty(spark):
    assert token_alignment.alignment(spark.createDataFrame([], DOCS), *ALIGNED).collect() == []
    assert [tuple(r) for r in token_alignment.alignment(spark.createDataFrame([(1, None)], DOCS), *ALIGNED).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def lloyd(rows, k, n_rounds, dims, scale):
    """Every vector against every centroid, on Python integers."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(n_rounds):
        now = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, now, strict=True) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)], centres


@pytest.mark.parametrize("seed", range(4))
def test_ball_kmeans(spark, seed):
    rng = np.random.default_rng(seed)
    dims = 4
    middle = rng.normal(size=(9, dims)) * 3
    rows = [(k, (middle[k % 9] + rng.normal(size=dims) * 0.3).astype(np.float32).tolist()) for k in range(300)]
    rows += [(1000 + k, [0.5] * dims) for k in range(40)] + [(1000, [0.5] * dims), (None, [0.25] * dims)]
    rows += [(2000, None), (2001, [1.0]), (2002, [float("nan")] * dims), (2003, [float("inf")] + [0.0] * (dims - 1)), (2004, [None] + [0.0] * (dims - 1))]
    if seed == 3:
        rows = [(k, [float(k % 3)] * dims) for k in range(60)]  # ties, equal centroids, clusters without members
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    want, centres = lloyd(rows, 12, 3, dims, 4 if seed == 2 else 64)
    got, found = ball_kmeans.clustered(df, 12, 3, dims, 4 if seed == 2 else 64)
    assert found.tolist() == centres
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_ball_kmeans_compares_few():
    """Far balls are no neighbours, members of the core meet no other centroid."""
    centres = np.array([[0, 0], [100, 0], [0, 1000]])
    balls = ball_kmeans.Balls.of(centres, [60, 40, 10])
    assert [n.tolist() for n, _ in balls.neighbours] == [[1], [], []]
    best, d = ball_kmeans.reassigned(np.array([[0, 10], [50, 0], [55, 0], [90, 0]]), np.array([0, 0, 0, 1], np.int32), balls)
    assert best.tolist() == [0, 0, 1, 1] and d.tolist() == [100, 2500, 2025, 100]


def test_ball_kmeans_defined_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert ball_kmeans.judged(spark.createDataFrame([], schema)).collect() == []
    assert [r["cluster"] for r in ball_kmeans.judged(spark.createDataFrame([(1, [0.0] * 64), (1, [0.0] * 64)], schema)).collect()] == [0, 0]
    with pytest.raises(Exception, match="beyond"):
        ball_kmeans.judged(spark.createDataFrame([(1, [3e30] * 64)], schema)).collect()


def test_runs_of_starts_by_stretches(monkeypatch):
    from comanda.llm import suffix_dedup

    r = np.random.default_rng(4)
    size = r.integers(1, 9, 200)
    place = np.cumsum(size) - size
    least, ident = r.integers(0, 3, size.sum()), r.integers(0, 4, 200)
    want = []
    for u, (p, n) in enumerate(zip(place.tolist(), size.tolist())):
        goes = [*(least[p : p + n] < ident[u]).tolist(), False]
        begin = None
        for k, g in enumerate(goes):
            if g and begin is None:
                begin = k
            elif not g and begin is not None:
                want.append((u, begin, k - begin))
                begin = None
    for starts in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "STARTS", starts)
        got = [x for part in suffix_dedup._runs(size, place, ident, least) for x in zip(*(c.tolist() for c in part), strict=True)]
        assert got == want

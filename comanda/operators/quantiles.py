"""Boosted quantile trees: gradient boosting on the pinball loss from distributed histograms.

Features are put into bins once. A level of a tree is one aggregation: rows and gradients by quantile,
node, feature and bin, added up in the tasks first. The driver sees the sums alone, whose number follows from the
parameters, and chooses the splits. A leaf holds the quantile of what is left to explain in it.
All quantiles grow side by side in the same passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.session import written

BINS, TREES, DEPTH, RATE, LEAST = 32, 10, 3, 0.3, 20
#: Rank error of quantiles: one in ACCURACY of the rows.
ACCURACY = 10_000


@dataclass
class Tree:
    """splits: node (root 1, children 2n and 2n + 1) to feature and bin; leaves: node to value."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def at(self, goes_right, leaf, node: int = 1) -> Column:
        """The expression of a row's leaf, ``leaf(node)``; ``goes_right(feature, bin)`` tells the way."""
        if node not in self.splits:
            return leaf(node)
        return F.when(goes_right(*self.splits[node]), self.at(goes_right, leaf, 2 * node + 1)).otherwise(self.at(goes_right, leaf, 2 * node))


@dataclass
class BoostedQuantiles:
    features: list[str]
    shares: tuple[float, ...]
    thresholds: list[list[float]]
    bases: list[float]
    trees: list[list[Tree]]

    def said(self, k: int, goes_right) -> Column:
        value = F.lit(self.bases[k])
        for tree in self.trees[k]:
            value = value + F.lit(RATE) * tree.at(goes_right, lambda n, t=tree: F.lit(t.leaves.get(n, 0.0)))
        return value

    def predicted(self, k: int) -> Column:
        """The k-th quantile of a row with the feature columns."""
        return self.said(k, lambda f, b: F.col(self.features[f]) > self.thresholds[f][b])


def _split(rows: list, shares: int, features: int, least: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(quantile, node) to the (feature, bin) whose halves differ most in gradient, where one gains."""
    sums: dict[tuple[int, int], list[dict[int, tuple[int, float]]]] = {}
    for r in rows:
        sums.setdefault((r["t"], r["node"]), [{} for _ in range(features)])[r["f"]][r["b"]] = (r["n"], r["g"])
    out = {}
    for key, by_feature in sums.items():
        best = 1e-9
        for f, bins in enumerate(by_feature):
            n, g = sum(x[0] for x in bins.values()), sum(x[1] for x in bins.values())
            left_n, left_g = 0, 0.0
            for b in sorted(bins)[:-1]:
                left_n, left_g = left_n + bins[b][0], left_g + bins[b][1]
                if min(left_n, n - left_n) < least:
                    continue
                gain = left_g**2 / left_n + (g - left_g) ** 2 / (n - left_n) - g**2 / n
                if gain > best:
                    best, out[key] = gain, (f, b)
    return out


def fitted(rows: DataFrame, target: str, features: list[str], shares: tuple[float, ...] = (0.5, 0.9), trees: int = TREES, depth: int = DEPTH, least: int = LEAST) -> BoostedQuantiles:
    """Quantiles ``shares`` of ``target`` from ``features`` (null counts as 0)."""
    rows = rows.select(F.col(target).cast("double").alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)])
    cuts = [k / BINS for k in range(1, BINS)]
    told = rows.agg(F.percentile_approx("y", list(shares), ACCURACY).alias("y"), *[F.percentile_approx(f"x{k}", cuts, ACCURACY).alias(f"x{k}") for k in range(len(features))]).first()
    model = BoostedQuantiles(features, shares, [sorted(set(told[f"x{k}"] or [])) for k in range(len(features))], list(told["y"] or [0.0] * len(shares)), [[] for _ in shares])
    place = lambda k: F.size(F.filter(F.array(*map(F.lit, model.thresholds[k])), lambda t: t < F.col(f"x{k}"))) if model.thresholds[k] else F.lit(0)
    rows = written(rows.select("y", F.array(*[place(k) for k in range(len(features))]).alias("bins")), "binned")
    right = lambda f, b: F.col("bins")[f] > b
    for _ in range(trees):
        left = [F.col("y") - model.said(k, right) for k in range(len(shares))]
        pull = [F.when(left[k] > 0, share).otherwise(share - 1.0) for k, share in enumerate(shares)]
        grown = [Tree() for _ in shares]
        for level in range(depth):
            each = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), grown[k].at(right, F.lit).alias("node"), pull[k].alias("g")) for k in range(len(shares))]))
            at = rows.select("bins", each.alias("e")).filter(F.col("e.node") >= 1 << level)
            sums = at.select("e.*", F.posexplode("bins").alias("f", "b")).groupBy("t", "node", "f", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("g"))
            chosen = _split(sums.collect(), len(shares), len(features), least)  # quantiles x nodes x features x BINS rows at most
            for (k, node), split in chosen.items():
                grown[k].splits[node] = split
            if not chosen:
                break
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), grown[k].at(right, F.lit).alias("node"), left[k].alias("left")) for k in range(len(shares))]))
        for r in rows.select(each.alias("e")).groupBy("e.t", "e.node").agg(F.percentile_approx("e.left", list(shares), ACCURACY).alias("p")).collect():  # a row a leaf
            grown[r["t"]].leaves[r["node"]] = r["p"][r["t"]]
        for k, tree in enumerate(grown):
            model.trees[k].append(tree)
    return model


def pinball(rows: DataFrame, actual: str, said: str, share: float) -> float:
    error = F.col(actual) - F.col(said)
    return rows.agg(F.avg(F.greatest(error * share, error * (share - 1)))).first()[0]

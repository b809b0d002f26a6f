"""Toxicity scores by weak supervision.

Many voters look at a text: one for each fixed lexicon word, lexicons of words and word beginnings
mined from labelled training rows, and patterns of writing. Training rows are dealt to folds by a
hash of their text, and the lexicons that vote on one fold are mined from the others. A generative
label model (two classes, votes given the class; expectation maximisation) estimates each voter's
accuracy from the votes. The given labels anchor it as evidence of the fixed reliability TRUST, so
voters that agree overrule a label. Correlations of voters given the class lower the weight of those that repeat each other. A linear
classifier over hashed words and word beginnings, sparse by an L1 penalty, is trained on the model's
posterior labels and scores every whole text.

Learning sees at most TRAINING_ROWS labelled rows outside the held-out fifth; scores use the text
alone. Scoring is one scan without a shuffle.

Defined cases: null and empty texts score as texts without words; rows with null labels or ids are
not learned from; without any training row every score is 0.0; repeated rows score alike; other
columns pass unchanged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comanda.llm.common import Sparse, held_out, set_aside, training_rows
from comanda.session import written

#: Documented bound of what is learned from; the mined lexicons have no bound of their own.
TRAINING_ROWS = 4000
#: Rows that a mined entry needs, a word that marks clean texts needs, and the share of toxic ones.
LEAST_ROWS, LEAST_CLEAN, PURITY = 5, 25, 0.9
FOLDS, TRUST = 4, 0.95
#: Insults, one voter each.
LEXICON = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
LETTERS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
N_FEATURES = 1 << 18
SHOUT, MARKS = re.compile(r"!{2,}"), re.compile(r"[#$%&*@]{3,}")


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


@dataclass
class Voters:
    """Votes 1 (toxic), -1 (not toxic) or 0 (abstains) on a text."""

    mined: dict[int, frozenset[str]]  # by length of beginning; 0 for whole words
    clean: frozenset[str]
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = [*LEXICON, "many of the lexicon", *[f"mined {k or 'words'}" for k in self.mined], "mined many", "no entry", "clean words", "shouting", "upper case", "marks", "repetition"]

    def votes(self, text: str | None) -> list[int]:
        text = text or ""
        words = words_of(text)
        known = [w in words for w in LEXICON]
        n = sum(known)
        mined = [len(words & self.mined[0]) if k == 0 else sum(w[:k] in self.mined[k] for w in words if len(w) > k) for k in self.mined]
        tokens = text.split()
        letters = sum(map(str.isupper, text)) / max(1, sum(map(str.isalpha, text)))
        calm = n == 0 and not any(mined)
        return [
            *[int(x) for x in known],
            1 if n > 1 else 0,
            *[int(m > 0) for m in mined],
            1 if sum(mined) > 2 else 0,
            -1 if calm else 0,
            -1 if calm and words & self.clean else 0,
            1 if len(SHOUT.findall(text)) > 2 and n else 0,
            -1 if letters > 0.6 and calm else 0,
            -1 if len(MARKS.findall(text)) > 2 and calm else 0,
            -1 if len(tokens) > 20 and len(set(tokens)) < len(tokens) / 3 and calm else 0,
        ]


@dataclass
class LabelModel:
    """P(vote | class) of each voter, the class prior and the voters' weights."""

    log_odds: np.ndarray  # voter x vote (-1, 0, 1)
    prior: float
    weights: np.ndarray
    accuracies: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        s = math.log(self.prior / (1 - self.prior)) + (self.log_odds[np.arange(votes.shape[1]), votes + 1] * self.weights).sum(axis=1)
        s = s + math.log(TRUST / (1 - TRUST)) * given
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 30) -> LabelModel:
    """Fits the generative model to ``votes`` (rows x voters) and the given labels (1 toxic, -1 not).

    Accuracies, the classes' shares, correlations within the classes and the weights that follow
    from them are found anew in each round; a voter that abstains says nothing.
    """
    n, m = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    p = np.where(given == 1, TRUST, 1 - TRUST)
    for _ in range(rounds):
        toxic = np.einsum("i,ijv->jv", p, one_hot) + 0.5
        clean = np.einsum("i,ijv->jv", 1 - p, one_hot) + 0.5
        toxic, clean = toxic / toxic.sum(axis=1, keepdims=True), clean / clean.sum(axis=1, keepdims=True)
        prior = min(0.9, max(0.01, p.mean()))
        v = np.array([-1.0, 0.0, 1.0])
        rest = votes - np.outer(p, toxic @ v) - np.outer(1 - p, clean @ v)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlations = (rest.T @ rest / n) / np.outer(spread, spread)
        moving = spread > 1e-6
        shared = np.clip(correlations, 0, 1) * np.outer(moving, moving)
        np.fill_diagonal(shared, 0)
        odds = np.log(toxic / clean)
        odds[:, 1] = 0.0
        model = LabelModel(odds, prior, 1 / (1 + shared.sum(axis=1)), toxic[:, 2] * prior + clean[:, 0] * (1 - prior), correlations)
        p = model.posterior(votes, given)
    return model


def _slot(feature: str) -> int:
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) % N_FEATURES


def features_of_word(word: str, mined: dict[int, frozenset[str]]) -> list[int]:
    """The word, its beginnings, and the lexicons that it is in."""
    found = [_slot(word), *[_slot(f"{word[:k]}-") for k in PREFIXES if len(word) > k]]
    if word in LEXICON:
        found.append(_slot("<lexicon>"))
    return found + [_slot(f"<mined {k}>") for k, entries in mined.items() if (word[:k] if k and len(word) > k else word) in entries]


@dataclass
class Scorer:
    """The trained classifier: sparse weights by feature, a bias, and the mined lexicons."""

    weights: dict[int, float]
    bias: float
    mined: dict[int, frozenset[str]] = field(default_factory=dict)

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        """``known`` remembers the words' sums between calls."""
        out = []
        for text in texts:
            total = self.bias
            for word in words_of(text):
                w = known.get(word)
                if w is None:
                    if len(known) > 200_000:
                        known.clear()
                    w = known[word] = sum(self.weights.get(f, 0.0) for f in features_of_word(word, self.mined))
                total += w
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, total)))))
        return out


def logistic(x: Sparse, target: np.ndarray, l1: float = 0.1, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression on soft targets (accelerated proximal gradient)."""
    step = 4 / (x.step() + x.n)
    w, b = np.zeros(x.n_features), 0.0
    yw, yb, t = w, b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(x.times(yw) + yb, -30, 30))) - target
        nw = yw - step * x.transposed_times(r)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb, nt = yb - step * r.sum(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        yw, yb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def mined_lexicons(sample: DataFrame) -> list[tuple[dict[int, frozenset[str]], frozenset[str]]]:
    """For rows of each fold, and last for rows of none: words and word beginnings that mark toxic
    rows of ``sample(text, toxic, fold)``, and words that mark the others, from the rows elsewhere."""
    words = sample.select("toxic", "fold", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("w"))
    rows = words.select("toxic", "fold", F.lit(0).alias("k"), "w")
    for k in PREFIXES:
        rows = rows.unionByName(words.filter(F.length("w") > k).select("toxic", "fold", F.lit(k).alias("k"), F.substring("w", 1, k).alias("w")))
    elsewhere = [F.when(F.col("fold") != f, 1).otherwise(0) for f in range(FOLDS + 1)]
    sums = [c for f, x in enumerate(elsewhere) for c in (F.sum(x).alias(f"n{f}"), F.sum(x * F.col("toxic")).alias(f"t{f}"))]
    counts = written(rows.groupBy("k", "w").agg(*sums).filter(f"n{FOLDS} >= {LEAST_ROWS}"), "word-counts")
    found = []
    for f in range(FOLDS + 1):  # words of the bounded sample
        bad = counts.filter(f"n{f} >= {LEAST_ROWS} and t{f} >= {PURITY} * n{f}").select("k", "w").collect()
        good = counts.filter(f"k = 0 and n{f} >= {LEAST_CLEAN} and t{f} = 0").select("w").collect()
        found.append(({k: frozenset(r["w"] for r in bad if r["k"] == k) for k in (0, *PREFIXES)}, frozenset(r["w"] for r in good)))
    return found


def trained(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> tuple[Scorer, LabelModel | None]:
    """The classifier, and the label model that made its training labels."""
    scorer, model, _ = learned(docs, labels, most)
    return scorer, model


def learned(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> tuple[Scorer, LabelModel | None, list[tuple[int, float]]]:
    """``trained``, and the given label and the posterior of every training row."""
    sample = training_rows(docs, labels, ["toxic"], most)
    # copies of a text fall into one fold
    sample = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)))
    lexicons = mined_lexicons(sample)
    voters = [Voters(*x) for x in lexicons]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, folds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            kept = [np.unique(np.array([x for w in words_of(t) for x in features_of_word(w, voters[f].mined)], np.int64), return_counts=True) for t, f in zip(texts, folds, strict=True)]
            votes = [voters[f].votes(t) for t, f in zip(texts, folds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(votes, pa.list_(pa.int32())), pa.array([c.astype(np.int32) for c, _ in kept], pa.list_(pa.int32())), pa.array([np.minimum(n, 30_000).astype(np.int16) for _, n in kept], pa.list_(pa.int16()))], ["toxic", "votes", "features", "counts"])

    rows = sample.select("text", F.col("toxic").cast("long"), "fold").mapInArrow(seen, "toxic long, votes array<int>, features array<int>, counts array<smallint>").toArrow()  # at most ``most`` rows
    if rows.num_rows == 0:
        return Scorer({}, -30.0), None, []
    given = np.where(rows.column("toxic").to_numpy() > 0, 1, -1)
    votes = np.array(rows.column("votes").to_pylist(), np.int64)
    model = label_model(votes, given)
    posterior = model.posterior(votes, given)
    x = Sparse([(c.values.to_numpy(), n.values.to_numpy()) for c, n in zip(rows.column("features"), rows.column("counts"), strict=True)], N_FEATURES)
    w, b = logistic(x, posterior)
    return Scorer({int(k): float(w[k]) for k in np.nonzero(w)[0]}, float(b), lexicons[FOLDS][0]), model, list(zip(given.tolist(), posterior.tolist(), strict=True))


def with_scores(docs: DataFrame, scorer: Scorer, name: str = "_toxicity") -> DataFrame:
    """``docs`` with the score of each whole text as ``name``."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name}; give another name")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            got = scorer.scores(batch.column(at).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=batch.schema.names)

    out = docs.withColumn(name, F.lit(None).cast("double"))
    return out.mapInArrow(score, out.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = with_scores(docs.select("doc_id", "text"), trained(docs, labels)[0], "score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5."""
    rows, restored = set_aside(docs, ("text",))
    return restored(with_scores(rows, trained(docs, labels)[0]).filter("_toxicity < 0.5"))

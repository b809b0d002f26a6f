"""Graded quality by ordinal cumulative-link regression on hashed text features.

P(grade <= g) = sigmoid(theta_g - w.x): one weight vector for all grades and ordered thresholds,
fitted by gradient steps on at most TRAINING_ROWS graded rows outside the held-out fifth. Features
are the hashed lower-cased words and word pairs that a text has, hashed shapes of its tokens
(letters, digits and marks as classes) and of their neighbours, and repetition, as shares of the
text. The model gives the expected grade and the probability of
each grade or better, which selects documents.

Scoring is one scan without a shuffle over whole texts.

Defined cases: null and empty texts have the one feature "empty"; rows without a grade or an id are
not learned from; with fewer than two grades every tail probability is 1.0 and all are kept;
repeated rows score alike; other columns pass unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comanda.llm.common import WORD, Hashes, Sparse, held_out, mixed, training_rows

TRAINING_ROWS = 6000
#: Feature numbers: shapes and shares of the text first, then words, then word pairs.
N_SHAPES, N_WORDS = 1 << 14, 1 << 18
N_FEATURES = N_SHAPES + 2 * N_WORDS
#: Values of a word and of a pair that a text has; pairs are many and mostly seen once.
WORD_VALUE, PAIR_VALUE = 0.2, 0.03
_PAIR = np.uint64(0x9E3779B97F4A7C15)
KEEP_AT = 0.5
_SHAPES = ((re.compile(r"[^\W\d_]+"), ""), (re.compile(r"\d+"), "9"))
_RUN = re.compile(r"(.)\1+")


def grade_of(quality: Column, toxic: Column) -> Column:
    """The grades of the test tables: 0 poor, 1 good but toxic, 2 good; null without a quality."""
    return F.when(quality == 0, 0).when(quality.isNotNull(), F.when(toxic == 1, 1).otherwise(2))


def shape(token: str) -> str:
    """Upper, capitalised, mixed or lower-case letters, digits and marks; runs become one and '+'."""
    letters = "A" if token.isupper() and len(token) > 1 else "a" if token.islower() else "Aa" if token.istitle() else "aA"
    for pattern, put in _SHAPES:
        token = pattern.sub(put or letters, token)
    return _RUN.sub(r"\1+", token)


class Slots(dict):
    """Feature numbers of tokens' shapes, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        s = self[token] = xxhash.xxh3_64_intdigest(shape(token).encode("utf-8", "surrogatepass")) % (N_SHAPES - 8)
        return s


def word_features(text: str, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of the lower-cased words and word pairs of a whole text."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    one = np.unique(mixed(h) % np.uint64(N_WORDS)).astype(np.int64)
    two = np.unique(mixed(h[:-1] * _PAIR + h[1:]) % np.uint64(N_WORDS)).astype(np.int64)
    return np.concatenate([N_SHAPES + one, N_SHAPES + N_WORDS + two]), np.repeat([WORD_VALUE, PAIR_VALUE], [len(one), len(two)])


def features(text: str | None, slots: Slots, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of a whole text."""
    tokens = (text or "").split()
    base = N_SHAPES - 8
    if not tokens:
        return np.array([base]), np.array([1.0])
    n = len(tokens)
    s = np.fromiter(map(slots.__getitem__, tokens), np.int64, n)
    both = (s[:-1] * 31 + s[1:] * 17 + 7) % base
    which, counts = np.unique(np.concatenate([s, both]), return_counts=True)
    lines = [x for x in text.split("\n") if x.strip()]
    rest = np.array([len(set(tokens)) / n, 1 - len(set(lines)) / max(1, len(lines)), n / (n + 40), np.log1p(sum(map(len, tokens)) / n) / 4, (text.count("|") + text.count("{")) / n])
    numbers, values = word_features(text, hashes)
    return np.concatenate([which, base + 1 + np.arange(5), numbers]), np.concatenate([np.sqrt(counts / n), rest, values])


@dataclass
class Ordinal:
    """Weights and ordered thresholds; ``tails`` are P(grade >= 1), P(grade >= 2), ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, x: Sparse) -> np.ndarray:
        s = x.times(self.weights)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -30, 30)))


def ordinal(x: Sparse, grades: np.ndarray, n_grades: int, l2: float = 1e-4, rounds: int = 600, rate: float = 0.05) -> Ordinal:
    """Maximum likelihood of the cumulative-link model (Adam on all rows; gaps of the thresholds as
    exponentials keep them in order)."""
    w, first, gaps = np.zeros(x.n_features), np.zeros(1), np.zeros(max(0, n_grades - 2))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first, gaps)]
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, rounds + 1):
        theta = np.concatenate([first, first + np.cumsum(np.exp(gaps))])
        s = x.times(w)
        upper = np.where(grades < n_grades - 1, sig(theta[np.minimum(grades, n_grades - 2)] - s), 1.0)
        lower = np.where(grades > 0, sig(theta[np.maximum(grades - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_theta = np.bincount(np.minimum(grades, n_grades - 2), -du * (grades < n_grades - 1), n_grades - 1) + np.bincount(np.maximum(grades - 1, 0), dl * (grades > 0), n_grades - 1)
        d_gap = np.array([d_theta[k + 1 :].sum() for k in range(len(gaps))]) * np.exp(gaps)
        grads = [x.transposed_times(du - dl) / x.n + l2 * w, np.array([d_theta.sum()]) / x.n, d_gap / x.n]
        for p_, g, m in zip((w, first, gaps), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p_ -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return Ordinal(w, np.concatenate([first, first + np.cumsum(np.exp(gaps))]))


def trained(docs: DataFrame, grades: DataFrame, most: int = TRAINING_ROWS) -> Ordinal:
    """Fits the model to ``grades(doc_id, grade)``, grades 0, 1, ..."""
    sample = training_rows(docs, grades, ["grade"], most)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, hashes = Slots(), Hashes()
        for batch in batches:
            rows = [features(t, slots, hashes) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([c.astype(np.int32) for c, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))], ["grade", "features", "values"])

    rows = sample.select("text", F.col("grade").cast("long")).mapInArrow(seen, "grade long, features array<int>, values array<float>").toArrow()
    grade = rows.column("grade").to_numpy().astype(np.int64)
    if not len(grade) or grade.max() == 0:
        return Ordinal(np.zeros(N_FEATURES), np.array([-30.0]))
    x = Sparse([(c.values.to_numpy(), v.values.to_numpy()) for c, v in zip(rows.column("features"), rows.column("values"), strict=True)], N_FEATURES)
    return ordinal(x, grade, int(grade.max()) + 1)


def with_tails(docs: DataFrame, model: Ordinal, name: str = "_tails") -> DataFrame:
    """``docs`` with P(grade >= 1), P(grade >= 2), ... of each whole text as ``name``."""
    if name in docs.columns:
        raise ValueError(f"the documents have a column {name}; give another name")
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, hashes = Slots(), Hashes()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = Sparse([features(t, slots, hashes) for t in batch.column(at).to_pylist()], N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(model.tails(x)), pa.list_(pa.float64()))], names=batch.schema.names)

    out = docs.withColumn(name, F.array().cast("array<double>"))
    return out.mapInArrow(score, out.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, expected_grade, p_good (grade 1 or better), p_best and keep of every row."""
    model = trained(docs, labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    rows = with_tails(docs.select("doc_id", "text"), model)
    tails = F.col("_tails")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.aggregate(tails, F.lit(0.0), lambda a, x: a + x).alias("expected_grade"), tails[0].alias("p_good"), F.element_at(tails, -1).alias("p_best"), (tails[0] >= KEEP_AT).alias("keep"))

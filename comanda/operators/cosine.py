"""Exact nearest neighbours by cosine of tf-idf grams, in blocks of pairs.

First every text gets a score that its k-th neighbour reaches at least: texts are sorted several times, by their words, by their
rarest grams and by grams drawn by weight, and each meets those of its window. Then texts are dealt into blocks by a hash
of their id. The blocks are written once, a row each, and every block of askers meets every block of texts in a Cartesian
product, whose tasks read the blocks from the files: no copy of a text is shuffled. A task adds up products of an asker's
rare grams only, as far as the norms of both texts' other grams cannot make up what is missing, and
computes the scores of the few pairs that can still reach the asker's bound. So no pair is left out that a product of all
pairs would find, equal scores at the bound included. No pair is shuffled, spilled or written; a task
holds its share of the blocks and a strip of sums. Grams are compared by 64-bit codes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.session import written

#: Texts of a block, and the fewest blocks, so that few texts are spread as well.
BLOCK, LEAST = 32_768, 6
#: Grams that are dense columns at most, each in so large a part of a block; scores and products at a time.
DENSE, COMMON, STRIP = 512, 1 / 50, 1 << 21
#: Scores are compared as rounded to so many places.
PLACES = 5
#: Grams whose counts are sent to the tasks at most; beyond it they are joined to their texts, with the same result.
SENT = 1 << 20
#: Texts of a window, how many sorts draw grams by weight, and texts of their tasks.
WINDOW, DRAWS, TASK = 256, 2, 10_000
#: Grams are rare up to one of these numbers of texts, which each asker chooses by work: a pair to score costs as much as PRICE
#: products, and pairs that are SLACK short of the bound count as such.
LEVELS, PRICE, SLACK = 2 ** np.arange(32), 50, 0.02
#: Products, and cells of a table of askers by grams, at a time; sums are first made of so many texts (a power of two) together.
PRODUCTS, TABLE, TOGETHER = 1 << 19, 1 << 20, 4


def joined_words(text: Column) -> Column:
    """The lower-cased words with one space between."""
    return F.array_join(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != ""), " ")


def gram_codes(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and 64-bit code of every gram of 2 to 4 characters of ``joined_words``, each word with a space on
    both sides."""
    chars = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(words)), [len(x) + 2 for x in words])
    gap = chars == 32
    number = lambda x: np.uint64(x)
    two = chars[:-1] << number(21) | chars[1:]
    three = two[:-1] << number(21) | chars[2:]
    four = (three[:-1] ^ three[:-1] >> number(31)) * number(0xBF58476D1CE4E5B9) + chars[3:] * number(0x9E3779B97F4A7C15)
    four = (four ^ four >> number(29)) * number(0x94D049BB133111EB)
    four = (four ^ four >> number(32)) | number(1 << 63)  # the others have 63 bits and are exact
    within = [~(gap[:-1] & gap[1:]), ~gap[1:-1], ~(gap[1:-2] | gap[2:-1])]  # two spaces lie between texts
    at = [np.flatnonzero(x) for x in within]
    codes = np.concatenate([x[i] for x, i in zip((two, three, four), at, strict=True)])
    return np.concatenate([row[i] for i in at]), codes.view(np.int64)


def tallied(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different codes, sorted, and by text each one's number among them and how often it occurs: codes, row, g, tf."""
    row, code = gram_codes(words)
    codes, g = np.unique(code, return_inverse=True)
    key, tf = np.unique(row * len(codes) + g, return_counts=True)
    return codes, *np.divmod(key, max(1, len(codes))), tf


class Vectors:
    """Vectors of unit length, those of a text from its rarest gram on: entries ``ends[i]`` to ``ends[i + 1]`` of ``g``, ``tf``
    and ``w``; ``g`` numbers ``codes`` and ``df``, the rarest first. ``n`` texts are there in all."""

    def __init__(self, n: int, ends: np.ndarray, g: np.ndarray, tf: np.ndarray, codes: np.ndarray, df: np.ndarray) -> None:
        self.ends, self.g, self.tf, self.codes, self.df, texts = ends, g, tf, codes, df, len(ends) - 1
        self.row = np.repeat(np.arange(texts), np.diff(ends))
        w = tf * (np.log((1 + n) / (1 + df)) + 1)[g]
        self.w = w / np.sqrt(np.bincount(self.row, w * w, texts))[self.row]

    @classmethod
    def of(cls, words: Sequence[str], n: int, codes: np.ndarray, df: np.ndarray) -> Vectors:
        """``df`` of the ``n`` texts have the gram of each of the sorted ``codes``."""
        own, row, g, tf = tallied(words)
        counts = df[np.searchsorted(codes, own)]
        order = np.lexsort((own, counts))
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        by = np.argsort(row * len(own) + place[g])
        return cls(n, np.searchsorted(row, np.arange(len(words) + 1)), place[g[by]].astype(np.int32), tf[by], own[order], counts[order])

    def products(self, lo: int, hi: int) -> np.ndarray:
        """Cosines of the texts from ``lo`` to ``hi`` with each other, about TABLE cells at a time."""
        at, m = slice(self.ends[lo], self.ends[hi]), hi - lo
        used = np.bincount(self.g[at], minlength=len(self.codes)) > 1
        row, w, column = self.row[at] - lo, self.w[at], np.where(used, np.cumsum(used) - 1, -1)[self.g[at]]
        out, width = np.zeros((m, m)), max(1, TABLE // m)
        for left in range(0, int(used.sum()), width):
            here = (column >= left) & (column < left + width)
            part = np.zeros((m, min(width, int(used.sum()) - left)))
            part[row[here], column[here] - left] = w[here]
            out += part @ part.T
        return out

    def drawn(self, seed: int) -> list[np.ndarray]:
        """The codes of three grams of each text, drawn alike for all texts, heavy grams rather than light ones."""
        x = (self.codes.view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        late = -np.log(((x ^ x >> np.uint64(32)) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-17)
        late = late[self.g] / (self.w * self.w)
        order = np.argsort(self.row + late / (1 + late))
        return [self.codes[self.g[order[a : min(a + 3, b)]]] for a, b in zip(self.ends, self.ends[1:], strict=False)]

    def first(self) -> list[np.ndarray]:
        """The codes of the three rarest grams of each text."""
        return [self.codes[self.g[a : min(a + 3, b)]] for a, b in zip(self.ends, self.ends[1:], strict=False)]


def _products(a_rows: np.ndarray, a_w: np.ndarray, counts: np.ndarray, starts: np.ndarray, cols: np.ndarray, b_w: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` each entry's weight times those of its gram's postings, about STRIP products at a time."""
    stops = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + STRIP, "right")))
        n = counts[at:to]
        hit = np.repeat(starts[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(a_rows[at:to], n) * out.shape[1] + cols[hit]
        out += np.bincount(cell, np.repeat(a_w[at:to], n) * b_w[hit], out.size).reshape(out.shape)
        at = to


def _best(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """id, other and score: the ``k`` best of ``b(id, g, w)`` for each of ``a(id, g, w)``, by products of all pairs; tests hold
    ``_Meeting`` to it."""
    if not len(a) or not len(b):
        return pd.DataFrame({"id": a["id"][:0], "other": b["id"][:0], "score": np.empty(0)})
    b = b.sort_values("id", ignore_index=True)
    rows = lambda x: np.repeat(np.arange(len(x)), x["g"].map(len))
    (a_row, a_w), (b_row, b_w) = ((rows(x), np.concatenate([*x["w"]])) for x in (a, b))
    grams, number = np.unique(np.concatenate([*a["g"], *b["g"]]), return_inverse=True)
    a_gram, b_gram = number[: len(a_w)], number[len(a_w) :]
    df = np.bincount(b_gram, minlength=len(grams))
    dense = np.argsort(-df, kind="stable")[:DENSE]
    dense = dense[df[dense] >= len(b) * COMMON]
    column = np.full(len(grams), -1)
    column[dense] = np.arange(len(dense))

    def matrix(row, gram, w, n):
        out, at = np.zeros((n, len(dense))), column[gram] >= 0
        out[row[at], column[gram[at]]] = w[at]
        return out

    common = matrix(b_row, b_gram, b_w, len(b)).T
    mine = matrix(a_row, a_gram, a_w, len(a))
    rare = (column[a_gram] < 0) & (df[a_gram] > 0)
    a_row, a_gram, a_w = a_row[rare], a_gram[rare], a_w[rare]
    order = np.argsort(b_gram, kind="stable")
    cols, b_w, starts = b_row[order], b_w[order], np.cumsum(df) - df
    own = pd.Index(b["id"]).get_indexer(a["id"])
    last_first = np.arange(len(b))[::-1]  # of equal scores the first other has the greatest key
    strip, found = max(1, STRIP // len(b)), []
    for at in range(0, len(a), strip):
        to = min(at + strip, len(a))
        score = mine[at:to] @ common
        lo, hi = np.searchsorted(a_row, (at, to))
        g = a_gram[lo:hi]
        _products(a_row[lo:hi] - at, a_w[lo:hi], df[g], starts[g], cols, b_w, score)
        here = np.nonzero(own[at:to] >= 0)[0]
        score[here, own[at:to][here]] = 0.0
        key = np.where(score > 0, np.rint(score * 10**PLACES).astype(np.int64) * len(b) + last_first, -1)
        top = np.argpartition(key, len(b) - k, axis=1)[:, -k:] if len(b) > k else np.tile(np.arange(len(b)), (to - at, 1))
        value = np.take_along_axis(key, top, 1)
        i, j = np.nonzero(value >= 0)
        found.append((i + at, top[i, j], value[i, j] // len(b)))
    i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"id": a["id"].to_numpy()[i], "other": b["id"].to_numpy()[j], "score": score / 10**PLACES})


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each of ``starts`` on."""
    stops = np.cumsum(n)
    return np.repeat(starts - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)


class Block(Vectors):
    """A block of texts with their ``ids``, sorted, and ``low``, a score that the k-th neighbour of each reaches."""

    def __init__(self, n: int, row: pd.Series, side: str) -> None:
        get = lambda c, kind: np.frombuffer(row[f"{side}_{c}"], kind)
        ends = get("ends", np.int64)
        some = lambda c: get(c, f"u{len(row[f'{side}_{c}']) // ends[-1]}")  # noqa: E731  # as small as _small made it
        super().__init__(n, ends, some("g").astype(np.int32), some("tf"), get("codes", np.int64), get("df", np.int64))
        self.ids, self.low, self.n = np.asarray(row[f"{side}_id"]), get("low", np.float64), len(ends) - 1
        self.level = np.searchsorted(LEVELS, self.df)
        #: By text and level: the norm of the level's entries, that of all from the level on, and how many come before.
        square = self.summed(self.w * self.w)
        self.norm, self.rest = np.sqrt(square), np.zeros((self.n, len(LEVELS) + 1), order="F")
        self.rest[:, :-1] = np.sqrt(square[:, ::-1].cumsum(1)[:, ::-1])
        self.before = self.until(np.ones(len(self.w))).astype(np.int64)

    def summed(self, x: np.ndarray) -> np.ndarray:
        """``x`` of the entries by text and level."""
        n = len(LEVELS)
        return np.bincount(self.row * n + self.level[self.g], x, self.n * n).reshape(self.n, n)

    def until(self, x: np.ndarray) -> np.ndarray:
        """``x`` of the entries by text, as summed before each level."""
        return np.hstack([np.zeros((self.n, 1)), self.summed(x).cumsum(1)])


class _Meeting:
    """A block of askers and one of texts."""

    def __init__(self, a: Block, b: Block) -> None:
        self.a, self.b = a, b
        by_code = np.argsort(b.codes)
        at = by_code[np.minimum(np.searchsorted(b.codes, a.codes, sorter=by_code), len(by_code) - 1)]
        self.to = np.where(b.codes[at] == a.codes, at, -1)  # a's gram numbers to b's
        postings = np.bincount(b.g, minlength=len(b.codes))
        self.count = np.where(self.to >= 0, postings[self.to], 0)
        self.lim = a.low - 1.1 / 10**PLACES  # scores that round to what low rounds to, and a little
        self.own = pd.Index(b.ids).get_indexer(a.ids)
        self.choose()
        few = np.flatnonzero(b.g < np.searchsorted(b.level, self.at.max()))
        few = few[np.argsort(b.g[few].astype(np.uint16) if len(b.codes) < 1 << 16 else b.g[few], kind="stable")]
        self.text, self.weight, self.start = b.row[few].astype(np.int32), b.w[few], np.cumsum(postings) - postings
        self.buckets = -(-b.n // (1 << TOGETHER))
        self.table = np.zeros((max(1, min(a.n, TABLE // len(b.codes))), len(b.codes)))

    def choose(self) -> None:
        """For each asker the level ``at``, its ``rest`` there, how many products come before it, and ``over``, how many texts may reach
        the bound by their rest alone."""
        a, b, top = self.a, self.b, len(LEVELS)
        hits = a.until(self.count[a.g].astype(np.float64))
        used = np.unique(np.concatenate([[0], 1 + np.unique(np.concatenate([a.level, b.level])), [top]]))
        self.by = {x: np.argsort(b.rest[:, x]) for x in used}
        self.sorted = {x: b.rest[order, x] for x, order in self.by.items()}
        self.most = {x: np.maximum.reduceat(b.rest[:, x], np.arange(0, b.n, 1 << TOGETHER)) for x in used}
        at, cost = np.full(a.n, top), hits[:, top].copy()
        for x in used[used < top]:
            with np.errstate(divide="ignore", invalid="ignore"):
                far = b.n - np.searchsorted(self.sorted[x], np.nan_to_num((self.lim - SLACK) / a.rest[:, x], nan=0.0))
            price = hits[:, x] + PRICE * far
            at, cost = np.where(price < cost, x, at), np.minimum(price, cost)
        self.at, every = at, np.arange(a.n)
        self.rest, self.hits, self.over = a.rest[every, at], hits[every, at], np.zeros(a.n, np.int64)
        for x in used[used < top]:
            mine = np.flatnonzero(at == x)
            need = np.divide(self.lim[mine], self.rest[mine], out=np.where(self.lim[mine] > 0, np.inf, 0.0), where=self.rest[mine] > 0)
            self.over[mine] = b.n - np.searchsorted(self.sorted[x], need - 1e-9)

    def pairs(self, mine: np.ndarray, x: int) -> np.ndarray:
        """asker * texts + text of those pairs of the askers ``mine`` at level ``x`` that may reach the bound."""
        a, b, rest, lim = self.a, self.b, self.rest[mine], self.lim[mine] - 1e-9
        e = _ranges(a.ends[mine], a.before[mine, x])
        i, g = np.repeat(np.arange(len(mine)), a.before[mine, x]), a.g[e]
        n = self.count[g]
        hit = _ranges(self.start[self.to[g]], n)
        i, j, value = np.repeat(i.astype(np.int32), n), self.text[hit], np.repeat(a.w[e], n) * self.weight[hit]
        cell = i * self.buckets + (j >> TOGETHER)
        may = np.bincount(cell, value, len(mine) * self.buckets).reshape(len(mine), -1) + rest[:, None] * self.most[x] >= lim[:, None]
        may = np.flatnonzero(may.ravel()[cell])
        key, value = i[may].astype(np.int64) * b.n + j[may], value[may]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            i, j = np.divmod(key[first], b.n)
            value = np.add.reduceat(value[order], first)
            may = np.flatnonzero(value + rest[i] * b.rest[j, x] >= lim[i])
            key, i, j, value = key[first[may]], i[may], j[may], value[may]
            key = key[value + np.einsum("ij,ij->i", a.norm[mine[i], x:], b.norm[j, x:]) >= lim[i]]
        over = self.over[mine]
        if over.any():
            alone = self.by[x][_ranges(b.n - over, over)]
            key = np.union1d(key, np.repeat(np.arange(len(mine)), over) * b.n + alone)
        i, j = np.divmod(key, b.n)
        return (mine[i] * b.n + j)[self.own[mine[i]] != j]

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the pairs, sorted by the asker."""
        a, b, out = self.a, self.b, np.empty(len(i))
        size = np.diff(b.ends)[j]
        asker = np.cumsum(np.diff(i, prepend=-1) > 0) - 1
        work = np.cumsum(size)
        at = 0
        while at < len(i):
            to = min(np.searchsorted(asker, asker[at] + len(self.table)), np.searchsorted(work, work[at] - size[at] + PRODUCTS, "right"))
            to = max(at + 1, int(to))
            who, r = np.unique(i[at:to], return_inverse=True)
            n = np.diff(a.ends)[who]
            e = _ranges(a.ends[who], n)
            g = self.to[a.g[e]]
            cell = (np.repeat(np.arange(len(who)), n) * len(b.codes) + g)[g >= 0]
            self.table.ravel()[cell] = a.w[e][g >= 0]
            e = _ranges(b.ends[j[at:to]], size[at:to])
            product = self.table.ravel()[np.repeat(r * len(b.codes), size[at:to]) + b.g[e]] * b.w[e]
            out[at:to] = np.add.reduceat(product, np.cumsum(size[at:to]) - size[at:to])
            self.table.ravel()[cell] = 0.0
            at = to
        return out

    def best(self, k: int) -> pd.DataFrame:
        """id, other and score: the ``k`` best of ``b`` for each asker, as far as they reach its bound."""
        a, b, found = self.a, self.b, []
        order = np.argsort(self.at, kind="stable")
        work = np.cumsum((self.hits + self.over + self.buckets)[order])
        at = 0
        while at < len(order):
            x = self.at[order[at]]
            to = min(np.searchsorted(self.at[order], x, "right"), np.searchsorted(work, (work[at - 1] if at else 0) + PRODUCTS, "right"))
            to = max(at + 1, int(to))
            key = np.sort(self.pairs(order[at:to], x))
            at = to
            if len(key):
                i, j = np.divmod(key, b.n)
                score = self.scores(i, j)
                places = np.rint(score * 10**PLACES).astype(np.int64)
                keep = np.flatnonzero((score > 0) & (score >= self.lim[i]))
                keep = keep[np.lexsort((j[keep], -places[keep], i[keep]))]
                first = np.flatnonzero(np.diff(i[keep], prepend=-1))
                nth = np.arange(len(keep)) - np.repeat(first, np.diff(first, append=len(keep)))
                keep = keep[nth < k]
                found.append((i[keep], j[keep], places[keep]))
        i, j, places = (np.concatenate([np.empty(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pd.DataFrame({"id": a.ids[i], "other": b.ids[j], "score": places / 10**PLACES})


def _kept(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of each id."""
    return rows.sort_values(["id", "score", "other"], ascending=[True, False, True]).groupby("id", sort=False).head(k)


def _met(n: int, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of blocks of ``n`` texts, those of one block of askers in sequence, to the ``k`` best of each asker."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, asked, held = None, None, None
        for batch in batches:
            for _, row in batch.iterrows():
                if row["a_block"] != at:
                    if held is not None:
                        yield held
                    at, asked, held = row["a_block"], Block(n, row, "a"), None
                found = _Meeting(asked, Block(n, row, "b")).best(k)
                held = found if held is None else _kept(pd.concat([held, found]), k)
        if held is not None:
            yield held

    return best


def nearest(texts: DataFrame, k: int = 6, asked: DataFrame | None = None) -> DataFrame:
    """id, other, score and rank: the ``k`` nearest other texts of each of ``texts(id, text)`` (ids are
    distinct), or of the ids of ``asked(id)``; equal scores by ``other``. Texts without a common gram are
    no neighbours; null and empty texts have none."""
    spark, kind = texts.sparkSession, texts.schema["id"].dataType.simpleString()
    rows = written(texts.select("id", F.coalesce(joined_words(F.col("text")), F.lit("")).alias("t")), "texts")
    n = rows.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK))
    rows = rows.filter("t <> ''").repartition(tasks)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            codes, _, g, _ = tallied(x["t"].tolist())
            yield pd.DataFrame({"g": codes, "df": np.bincount(g, minlength=len(codes))})

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            codes, row, g, _ = tallied(x["t"].tolist())
            yield pd.DataFrame({"id": x["id"].to_numpy()[row], "g": codes[g]})

    grams = written(rows.select("t").mapInPandas(counted, "g long, df long").groupBy("g").agg(F.sum("df").alias("df")), "grams")
    extra = ["g", "df"]
    if grams.count() <= SENT:
        extra, known = [], grams.toPandas().sort_values("g")
        sent = spark.sparkContext.broadcast((known["g"].to_numpy(), known["df"].to_numpy()))
    else:
        each = rows.mapInPandas(told, f"id {kind}, g long").join(grams, "g").groupBy("id").agg(F.collect_list(F.struct("g", "df")).alias("e"))
        rows = rows.join(each.select("id", "e.g", "e.df"), "id")

    def vectors(x: dict | pd.DataFrame) -> Vectors:
        if not extra:
            return Vectors.of(list(x["t"]), n, *sent.value)
        codes, first = np.unique(np.concatenate([*x["g"]]), return_index=True)
        return Vectors.of(list(x["t"]), n, codes, np.concatenate([*x["df"]])[first])

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            v = vectors(x)
            sorts = {"by0": v.first()} | {f"by{i + 1}": v.drawn(i) for i in range(DRAWS)}
            yield x.assign(**sorts, other=[[i] * k for i in x["id"]], score=[[-1.0] * k] * len(x))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each text's ``k`` best others of the window and of those that it has met before; none scores -1."""
        for x in batches:
            v, ids, m = vectors(x), x["id"].to_numpy(), len(x)
            best, score = np.repeat(np.arange(m)[:, None], k, 1), np.full((m, k), -1.0)
            cuts = np.linspace(0, m, math.ceil(m / WINDOW) + 1).astype(int)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                s, few = v.products(lo, hi), min(k, hi - lo - 1)
                np.fill_diagonal(s, -1.0)
                at = np.argpartition(s, hi - lo - few - 1, axis=1)[:, hi - lo - few :] if few else np.empty((hi - lo, 0), int)
                best[lo:hi, :few], score[lo:hi, :few] = at + lo, np.take_along_axis(s, at, 1)
            other, held = np.stack([*x["other"]]), np.stack([*x["score"]])
            new = ids[best]
            score[(new[:, :, None] == other[:, None, :]).any(2)] = -1.0
            other, score = np.hstack([other, new]), np.hstack([held, score])
            at = np.argsort(-score, axis=1)[:, :k]
            yield x.assign(other=[*np.take_along_axis(other, at, 1)], score=[*np.take_along_axis(score, at, 1)])

    sorts = [f"by{i}" for i in range(1 + DRAWS)]
    schema = ", ".join([f"id {kind}, t string", *[f"{c} array<long>" for c in [*extra, *sorts]], f"other array<{kind}>, score array<double>"])
    state = written(rows.mapInPandas(keyed, schema), "sorts")
    for by in ("t", *sorts):
        state = written(state.repartitionByRange(tasks, by, "id").sortWithinPartitions(by, "id").mapInPandas(windows, schema), "windows")
    low = F.greatest(F.array_min("score"), F.lit(0.0))
    state = state.select("id", "t", *extra, low.alias("low"))
    blocks = max(LEAST, math.ceil(n / BLOCK))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, x in zip(batch["block"], batch["x"], strict=True):
                x = pd.DataFrame([*x]).sort_values("id", ignore_index=True)
                v = vectors(x)
                parts = {"low": x["low"].to_numpy(np.float64), "ends": v.ends.astype(np.int64), "g": _small(v.g), "tf": _small(v.tf), "codes": v.codes, "df": v.df}
                yield pd.DataFrame([{"block": number, "id": x["id"].tolist()} | {c: p.tobytes() for c, p in parts.items()}])

    def dealt(rows: DataFrame) -> DataFrame:
        own = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.struct("id", "t", *extra, "low").alias("x"))
        each = own.repartition(blocks, "block").groupBy("block").agg(F.collect_list("x").alias("x"))  # about BLOCK texts a row
        return written(each.mapInPandas(block, f"block int, id array<{kind}>, low binary, ends binary, g binary, tf binary, codes binary, df binary"), "blocks")

    side = lambda rows, name: rows.select(*[F.col(c).alias(f"{name}_{c}") for c in rows.columns])
    every = dealt(state)
    askers = dealt(state.join(asked.select("id").distinct(), "id", "left_semi")) if asked is not None else every
    pairs = side(askers, "a").hint("shuffle_replicate_nl").crossJoin(side(every, "b"))
    met = pairs.mapInPandas(_met(n, k), f"id {kind}, other {kind}, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    return ranked.filter(F.col("rank") <= k)

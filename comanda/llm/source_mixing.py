"""Mixing sources to target weights with a low-discrepancy schedule.

Slots 0..N-1 carry golden-ratio points; a point falls into the cumulative weights of the sources
and so names the source of its slot. The k-th slot of a source takes the k-th block of equally
many words from that source's documents, laid end to end in a shuffled order and begun again when
they are used up (twice at most). A source that the points give too few slots for its target gets
the missing ones after slot N-1, and its last block ends at the target, so the words taken are the
target rounded to a whole word at any block length.

The mixed documents are the runs of words that blocks took from a document in one pass, with the
text between those words; they are written in the order of their first slots, so every stretch of
the mix holds the sources in their shares. Joins of slots and blocks are merge joins: either side
grows with the corpus, and small compressed shuffles of them are large once hashed.

Defined cases: null text has no words; null source is a source of its own, ranked last; repeated
rows are separate documents; empty tables give empty mixes; further columns are left alone.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comanda.llm.common import set_aside
from comanda.session import written

#: Fixed values of the mix: weights by rank of source, share of all words, most repeats.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_TIMES = 2
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Slots aimed at while blocks are shorter than MAX_BLOCK words.
AIM_SLOTS, MAX_BLOCK = 1 << 20, 1024
#: Words of neighbouring slots whose documents lie together in the mix, sorted by slot.
WORDS_A_STRETCH = 1 << 20
CELLS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A null-free key that keeps null apart from every string."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def targets(sized: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_TIMES) -> DataFrame:
    """One row per source: rank, weight, words, target words and its span of the unit interval.

    ``sized`` has source and size. The table has one row per source, so its global windows sort
    that many rows and no more.
    """
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = stats.withColumn("source_id", F.row_number().over(by_name).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_id") - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy(F.lit(1))
    filled = (
        ranked.withColumn("weight", w)
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("total", share * F.sum("source_size").over(everything))
    )
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "source_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    filled = filled.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    open_level = F.max(F.when(~F.col("full"), F.struct(-F.col("cap") / F.col("weight"), -F.col("source_id"), F.col("level")))).over(everything)["level"]
    filled = filled.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least(open_level * F.col("weight"), F.col("cap"))))
    upto = Window.partitionBy(F.lit(1)).orderBy("source_id")
    filled = filled.withColumn("hi", F.sum("target").over(upto) / F.sum("target").over(everything))
    hi = F.col("hi")
    return filled.select(
        "source", source_key(F.col("source")).alias("source_key"), "source_id", "weight", "source_size", "n_docs", "total", "target",
        F.coalesce(F.lag(hi).over(upto), F.lit(0.0)).alias("lo"),
        F.coalesce(hi, F.lit(0.0)).alias("hi"),
    )


def golden_point(n: Column) -> Column:
    """frac((n + 0.5) * golden ratio), exact to about 1e-10 for n below 2**40."""
    getcontext().prec = 50
    g = (Decimal(5).sqrt() - 1) / 2
    high, low = float(g * (1 << 20) % 1), float(g)
    a = F.floor(n / F.lit(1 << 20)).cast("double") * F.lit(high)
    b = (F.pmod(n, F.lit(1 << 20)).cast("double") + F.lit(0.5)) * F.lit(low)
    s = (a - F.floor(a)) + (b - F.floor(b))
    return s - F.floor(s)


def slots(source_table: DataFrame, n_slots: int, chunk: int = 8192) -> DataFrame:
    """(slot, source_id, k): the source of every slot and the slot's rank within it.

    Points meet the spans of the sources in CELLS equal cells. Ranks are counted per chunk of
    slots first, so no task holds all slots of a source.
    """
    spark = source_table.sparkSession
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = source_table.filter("hi > lo").select("source_id", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    # the last span takes what rounding leaves above it
    last = source_table.agg(F.max(F.when(F.col("hi") > F.col("lo"), F.struct("hi", "source_id")))["source_id"].alias("last_id"))
    spans = spans.join(F.broadcast(last)).withColumn("hi", F.when(F.col("source_id") == F.col("last_id"), F.lit(2.0)).otherwise(F.col("hi")))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("cell", cell(F.col("u")))
    placed = points.join(spans, "cell").filter((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi"))).select("slot", "source_id", F.floor(F.col("slot") / chunk).alias("chunk"))
    counts = placed.groupBy("source_id", "chunk").agg(F.count(F.lit(1)).alias("c"))
    past = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("source_id", "chunk", F.coalesce(F.sum("c").over(past), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_id", "chunk").orderBy("slot")
    return placed.withColumn("r", F.row_number().over(within) - 1).join(base, ["source_id", "chunk"]).select("slot", "source_id", (F.col("base") + F.col("r")).alias("k"))


def whole_slots(source_table: DataFrame, n_slots: int, block: int) -> DataFrame:
    """``slots`` with at least as many of each source as its target has blocks."""
    placed = written(slots(source_table, n_slots), "mix-slots")
    have = placed.groupBy("source_id").agg(F.count(F.lit(1)).alias("have"))
    short = source_table.select("source_id", F.ceil(F.round("target") / block).alias("need")).join(have, "source_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("need > have")
    # one row per source at most
    before = F.coalesce(F.sum(F.col("need") - F.col("have")).over(Window.partitionBy(F.lit(1)).orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = short.withColumn("first", n_slots + before).withColumn("k", F.explode(F.sequence(F.col("have"), F.col("need") - 1)))
    return placed.unionByName(more.select((F.col("first") + F.col("k") - F.col("have")).alias("slot"), "source_id", "k"))


def laid_out(sized: DataFrame, n_docs: int, seed: int, per_chunk: int = 20_000) -> DataFrame:
    """Adds ``offset``: words of the source's earlier documents in its shuffled order.

    The order is that of a hash of doc_id; sums over its leading bits come first, so no task adds
    up all documents of a source.
    """
    bits = max(1, (max(n_docs, 1) // per_chunk).bit_length())
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    keyed = sized.withColumn("h", F.shiftrightunsigned(h, 1)).withColumn("chunk", F.shiftright(F.col("h"), 63 - bits))
    sums = keyed.groupBy("source_id", "chunk").agg(F.sum("size").alias("c"))
    past = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source_id", "chunk", F.coalesce(F.sum("c").over(past), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_id", "chunk").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = keyed.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(base, ["source_id", "chunk"]).withColumn("offset", F.col("base") + F.col("own")).drop("h", "chunk", "own", "base")


def mix(docs: DataFrame, weights=WEIGHTS, share=TOTAL_SHARE, most=MOST_TIMES, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents with size, target and offset; the mix's pieces).

    Pieces: slot, source_id, k, offset, pass (times the source was used up before), first_word,
    n_words and stretch (which WORDS_A_STRETCH words of the mix the slot is in). A document's pieces
    carry its source_id and offset.
    """
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = written(targets(sized, weights, share, most), "mix-sources")
    head = sources.agg(F.max("total").alias("total"), F.sum("n_docs").alias("n"), F.sum("target").alias("target")).first()
    total, n_docs = float(head["target"] or 0.0), int(head["n"] or 0)
    block = int(max(1, min(MAX_BLOCK, -(-total // AIM_SLOTS))))
    n_slots = int(-(-total // block))
    # one row per source; Spark broadcasts it only while its written size is under the threshold
    keyed = sized.withColumn("source_key", source_key(F.col("source"))).join(sources.select("source_key", "source_id", "source_size", "target"), "source_key").drop("source_key")
    laid = written(laid_out(keyed, n_docs, seed), "mix-order")
    passes = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    runs = laid.filter("size > 0").select("source_id", "source_size", "offset", "size", F.round("target").cast("long").alias("most_words"), passes)
    a = F.col("pass") * F.col("source_size") + F.col("offset")
    b = a + F.col("size")
    runs = runs.withColumn("a", a).withColumn("b", F.least(b, F.col("most_words"))).filter("a < b")
    pieces = runs.select("source_id", "offset", "pass", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("k"))
    first = F.greatest(F.col("k") * block, F.col("a"))
    pieces = pieces.withColumn("first_word", first - F.col("a")).withColumn("n_words", F.least((F.col("k") + 1) * block, F.col("b")) - first)
    taken = whole_slots(sources, n_slots, block).join(pieces.drop("a", "b").hint("merge"), ["source_id", "k"])
    return laid, taken.withColumn("stretch", F.floor(F.col("slot") * block / WORDS_A_STRETCH))


def runs_of_words(pieces: DataFrame) -> DataFrame:
    """The pieces of one document and pass in one row: source_id, offset, pass, first_slot, stretch, first_word, n_words.

    Blocks lie end to end, so the words that they take from a document in one pass are one run.
    """
    per_pass = pieces.groupBy("source_id", "offset", "pass")
    return per_pass.agg(F.min("slot").alias("first_slot"), F.min("stretch").alias("stretch"), F.min("first_word").alias("first_word"), F.sum("n_words").alias("n_words"))


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """Per document row: doc_id, source, size, source_size, target, source_id, offset, taken and
    runs (first_slot, stretch, first_word and n_words of each pass)."""
    laid, pieces = mix(docs, **how)
    run = F.struct("pass", "first_slot", "stretch", "first_word", "n_words")
    per_doc = runs_of_words(pieces).groupBy("source_id", "offset").agg(F.sum("n_words").alias("taken"), F.sort_array(F.collect_list(run)).alias("runs"))  # a run a pass
    full = laid.filter("size > 0").join(per_doc.hint("merge"), ["source_id", "offset"], "left")
    empty = laid.filter("size = 0")
    both = full.unionByName(empty, allowMissingColumns=True)
    return both.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def words_between(text: Column, first: Column, n: Column) -> Column:
    """``n`` words of ``text`` from word ``first`` (0 the first) on, with what stands between them."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    run = F.array_join(F.slice(pieces, (first + 1).cast("int"), n.cast("int")), "")
    return F.when(first == 0, run).otherwise(F.regexp_replace(run, r"^[\x20\x09-\x0D]+", ""))


def scheduled(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents in no order: the columns of ``docs``, and ``_slot`` and ``_stretch``, the
    first of each run.

    A run of a whole document keeps the text as it is; ``n_chars`` follows a shortened text.
    """
    chosen = taken_words(docs, **how).filter("taken > 0")
    rows = chosen.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), "size", F.explode("runs").alias("run"))
    # repeated rows of one document are equal in size and source, so each takes part once
    rows = rows.groupBy("_doc", "_source", "size").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    same = Window.partitionBy("doc_id", "source", "_size").orderBy("text")
    texts = docs.withColumn("_size", n_words(F.col("text")))
    joined = texts.join(rows.hint("merge"), (F.col("doc_id").eqNullSafe(F.col("_doc"))) & (F.col("source").eqNullSafe(F.col("_source"))) & (F.col("_size") == F.col("size")))
    joined = joined.withColumn("_r", F.row_number().over(same) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "source", "_size")))
    dealt = joined.withColumn("_own", F.filter("runs", lambda x, i: F.pmod(i, F.col("_m").cast("int")) == F.col("_r")))
    out = dealt.withColumn("_run", F.explode("_own"))
    part = words_between(F.col("text"), F.col("_run.first_word"), F.col("_run.n_words"))
    out = out.withColumn("_whole", F.col("_run.n_words") == F.col("_size")).withColumn("text", F.when(F.col("_whole"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_whole"), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*[out[c] for c in docs.columns], F.col("_run.first_slot").alias("_slot"), F.col("_run.stretch").alias("_stretch"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents with the columns of ``docs``, sorted by slot within stretches of WORDS_A_STRETCH words, which are as many as the mix is large."""
    docs, restored = set_aside(docs, ("doc_id", "text", "source", "n_chars"))
    rows = scheduled(docs, **how)
    rows = rows.repartition("_stretch").sortWithinPartitions("_slot", "doc_id")
    return restored(rows)

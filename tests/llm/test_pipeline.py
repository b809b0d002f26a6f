"""The corpus pipeline on a small folder of tables with odd rows: every stage against brute force."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from comanda.llm import source_mixing, toxicity
from comanda.llm.queries import END_ID, TOKENIZER
from comanda.session import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _slot string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [words(rng, 40) for _ in range(3)]
    clean = [words(rng, rng.randint(30, 90)) for _ in range(60)]
    toxic = [words(rng, 20) + " idiot worthless scum " + words(rng, 10) for _ in range(30)]
    texts = clean + toxic
    texts += [clean[0], clean[1] + " tail", clean[2].replace(clean[2].split()[20], "other", 1), "start " + bench[0] + " end", clean[5] + "\n\n" + bench[1].upper(), "", None, "two words", "ab " * 3000]
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or ""), 1, "x") for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, clean[7] + " null id", None, "s1", None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(60 <= k < 90)) for k in range(90)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(bench)] + [(9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, bench


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return a == b or bool(a and b) and len(a & b) / len(a | b) >= 0.8


def test_stages_equal_brute_force(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    key = lambda r: (repr(r["doc_id"]), repr(r["text"]))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_join", "decontamination", "source_mixing", "token_binary"]

    kept = written(stages["toxicity"](spark, docs, path), "t1")
    assert kept.columns == docs.columns
    judged = {(r["doc_id"]): r["predicted"] for r in toxicity.judged(docs, labels).collect()}
    got = kept.collect()
    assert sorted(map(key, got)) == sorted((repr(r[0]), repr(r[1])) for r in rows if not judged[r[0]])
    assert sum(60 <= (r["doc_id"] or 0) < 90 for r in got) <= 2 and sum((r["doc_id"] or 99) < 60 for r in got) >= 60

    single = written(stages["ngram_join"](spark, kept, path), "t2")
    before, after = [shingle_set(r["text"]) for r in got], single.collect()
    assert single.columns == docs.columns
    left = [shingle_set(r["text"]) for r in after]
    assert all(not alike(a, b) for i, a in enumerate(left) for b in left[:i])
    assert all(any(alike(a, b) for b in left) for a in before)
    assert {key(r) for r in after} <= {key(r) for r in got}

    pure = written(stages["decontamination"](spark, single, path), "t3")
    fold = lambda t: " ".join(re.findall(r"\w+", (t or "").lower()))
    assert sorted(map(key, pure.collect())) == sorted(key(r) for r in after if not any(fold(b) in fold(r["text"]) for b in bench))
    assert pure.columns == docs.columns

    mix = written(stages["source_mixing"](spark, pure, path), "t4")
    assert mix.columns == docs.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken: dict = {}
    for r in mix.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    targets = {r["source"]: r["target"] for r in source_mixing.taken_words(pure).select("source", "target").distinct().collect()}
    assert all(abs(taken.get(s, 0) - t) <= 1 for s, t in targets.items())
    texts = {r["doc_id"]: r["text"] or "" for r in pure.collect()}
    assert all(texts[r["doc_id"]].startswith(r["text"]) for r in mix.collect())

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    out = stages["token_binary"](spark, mix, path).collect()
    want = sorted((repr(r["doc_id"]), zlib.crc32(np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, END_ID], "<u4").tobytes())) for r in mix.collect())
    assert sorted((repr(r["doc_id"]), r["ids_crc32"]) for r in out) == want

    # the token files follow the slots of the mix, where sources alternate as their weights tell
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    slots = source_mixing.scheduled(pure.select("doc_id", "text", "source", "n_chars")).orderBy("_slot", "doc_id").select("doc_id", "source", "_stretch").collect()
    assert {r["_stretch"] for r in slots} == {slots[0]["_stretch"]}
    assert order == [r["doc_id"] for r in slots] and order != sorted(order, key=lambda x: (x is not None, x))
    sources = [r["source"] for r in slots]
    assert sum(a != b for a, b in zip(sources, sources[1:], strict=False)) > len(sources) / 2


def test_run_on_the_folder_and_on_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    out = corpus_pipeline.run(spark, path)
    rows = out.orderBy("start").collect()
    assert rows and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

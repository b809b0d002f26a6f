"""What the token stage holds at once does not grow with partitions, texts or odd parts."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from comanda.llm import token_binary
from comanda.llm.queries import END_ID, N_VOCAB, TOKENIZER

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_store_takes_a_portion_at_a_time_and_no_long_parts():
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(100_000)]
    texts = [" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)] + [f"a {'xy' * 3000} b", f"a {'漢' * 300} b", None, ""]
    pieces = token_binary.Parts(TOKENIZER, bound=1000)
    got = pieces.of_texts(texts)
    assert len(pieces) < 50_000  # all were held, 100 000
    assert max(map(len, pieces)) <= 101
    for k in (0, 50, 99, 100, 101):
        assert got[k] == pieces.encoded(texts[k])
    assert got[102:] == [b"", b""]


def test_tokens_are_made_from_small_batches(spark, monkeypatch):
    before, seen, written = spark.conf.get(BATCH_BYTES), [], token_binary.written

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    docs = spark.range(6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ten chars "), 200).alias("text"))

    def spied(df, name):
        seen.extend(r["bytes"] for r in docs.mapInArrow(sizes, "bytes long").collect())
        return written(df, name)

    monkeypatch.setattr(token_binary, "written", spied)
    manifest = token_binary.write_shards(docs, TOKENIZER, N_VOCAB, END_ID)
    assert max(seen) < 5_000_000 and sum(seen) > 12_000_000
    assert spark.conf.get(BATCH_BYTES) == before
    rows = token_binary.read_digests(manifest).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(6000)) and len({r["ids_crc32"] for r in rows}) == 1

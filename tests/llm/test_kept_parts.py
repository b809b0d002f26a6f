"""Parts of texts outlive a task, and a full store keeps those met first."""

from comanda.llm import token_alignment, token_binary
from comanda.llm.queries import ALIGNED, TOKENIZER


def test_parts_are_kept_and_bounded():
    assert token_binary.kept_parts(TOKENIZER) is token_binary.kept_parts(TOKENIZER)
    pieces = token_binary.Parts(TOKENIZER, bound=10)
    texts = ["the cat sat on the mat", *[f"word {'ab' * k} end" for k in range(1, 20)]]
    for x in [*texts, *texts]:
        assert pieces.of_texts([x]) == [pieces.encoded(x)]
    assert list(pieces)[:1] and {"the", "cat", "sat", "on", "mat"} <= set(pieces) and len(pieces) <= 14


def test_units_are_kept_bounded_and_encoded_in_runs(monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20_000)
    monkeypatch.setattr(token_alignment, "STAY", 10_000, raising=False)
    plain, both = (token_alignment.Tokenizers(*ALIGNED) for _ in range(2))
    calls = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return plain.a.encode_batch_fast(texts, **options)

    both.a = Counted()
    first = [f"common{k}" for k in range(10)]
    for k in range(40):
        texts = [" ".join([*first, *(f"w{k}x{j}" for j in range(20))]), "odd \r end ", "ﬁn x\n"]
        for text, got in zip(texts, both.of_texts(texts), strict=True):
            a, b = plain.a.encode(" " + text, add_special_tokens=False).ids, plain.b.encode(text)
            whole = b"".join(plain.bytes_b[x] for x in b) == (" " + text).encode()
            assert [memoryview(x).cast("i").tolist() for x in got] == ([a, b] if whole else [[], []])
        assert all(n <= 3 for n in calls)  # a run of all new words, and at most two texts that stand alone
        assert both.remembered <= 20_000 + 30 * 300 and both.stay_bytes <= 10_000
        assert list(both.of_a) == list(both.of_b) and both.unlike <= set(both.of_a)
    assert {f" {x}" for x in first} <= set(both.of_a)

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from matchlake.llm.tokens import Pieces, counts_of, packed, token_counts, token_table, unpacked, within_limit

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_are_the_librarys(docs, corpus, library, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect())
    counts = [len(e.ids) for e in library.encode_batch([t or "" for _, t in corpus], add_special_tokens=False)]
    assert got == sorted((i if i is not None else -1, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(corpus, counts))
    assert token_counts(empty, PATH).collect() == []


def test_every_prefix_is_exact(library):
    rng, known = random.Random(1), Pieces(PATH)
    texts = ["a" * 300, " " * 90 + "x", "it's I'll we've they're 'llama 'x", "end  \n\n\t next  ", "漢字かな" * 40, "<|endoftext|>", "a <|endoftext|><|endoftext|> b !<|endoftext|>", "-" * 130]
    texts += ["".join(rng.choice([rng.choice("abcdeé ß'sl\n\t 1234.!?漢字🙂  "), "the", " and", "'ll", "'re", "  ", "\n\n", "<|endoftext|>", "<|end"]) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    for text in texts:
        got = counts_of(known.steps(text)).tolist()
        assert got == [len(e.ids) for e in library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)], text


def test_budgets_from_the_table(spark, library):
    """The longest prefix within a budget, also inside one piece of thousands of letters."""
    texts = ["the quick brown fox jumps over a lazy dog " * 50, "字" * 5000, "ab" * 7500, "short", "", None]
    table = token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).cache()
    for limit in (0, 1, 64, 1024):
        for r in within_limit(table, limit).collect():
            text = texts[r.doc_id] or ""
            n = lambda i, text=text: len(library.encode(text[:i], add_special_tokens=False).ids)
            assert r.over_limit == (n(len(text)) > limit) and n(r.cut_chars) <= limit
            assert r.cut_chars == len(text) or all(n(i) > limit for i in range(r.cut_chars + 1, min(len(text), r.cut_chars + 40) + 1))
            assert limit < 64 or len(text) < 20 or r.cut_chars >= 32


def test_steps_beyond_a_byte():
    rng = random.Random(3)
    for _ in range(50):
        steps = [rng.choice((0, 1, -1, 127, -127, 128, -128, 200, -5000, 1 << 40)) for _ in range(rng.randint(0, 30))]
        assert unpacked(packed(steps)).tolist() == steps and counts_of(packed(steps)).tolist() == [sum(steps[:i]) for i in range(len(steps) + 1)]
    assert len(packed([1, -3, 127])) == 3 and len(packed([1, 128])) == 10


def test_a_table_with_wide_steps(spark, library, monkeypatch):
    """As if every step were too wide for a byte: all answers stay the same."""
    texts = ["the quick  brown fox " * 20, "字" * 50, "a <|endoftext|> b", ""]
    plain = {t: Pieces(PATH).steps(t) for t in texts}
    monkeypatch.setattr(Pieces, "worked_out", lambda self, piece, f=Pieces.worked_out: b"".join(b"\x80" + int(x).to_bytes(8, "little", signed=True) for x in unpacked(f(self, piece))))
    wide = {t: Pieces(PATH).steps(t) for t in texts}
    for t in texts:
        assert counts_of(wide[t]).tolist() == counts_of(plain[t]).tolist()
    rows = [(i, len(t.encode()), int(unpacked(wide[t]).sum()), wide[t]) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, n_bytes long, n_tokens long, steps binary")
    assert {r.doc_id: r.cut_chars for r in within_limit(table, 10_000).collect()} == {i: len(t) for i, t in enumerate(texts)}

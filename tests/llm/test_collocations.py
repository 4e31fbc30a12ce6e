"""Collocations: counts and ranks against plain dictionaries, whatever the memory budget of a group."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from matchlake.llm import collocations as co
from matchlake.llm.collocations import collocations, phrase_counts, pieces
from tests.llm.conftest import prose


def split(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def counted(rows, depth=4):
    f = Counter()
    for lang, text in rows:
        for w in split(text):
            for d in range(1, depth + 1):
                f.update((lang or "und", tuple(w[a : a + d])) for a in range(len(w) - d + 1))
    return f


def brute(rows, least, most, depth=4, inside=80):
    f = counted(rows, depth)
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c * (len(w) == 1)
    held = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    found = []
    for (lang, w), a in held.items():
        if any(lang == q[0] and len(q[1]) > len(w) and 100 * c >= inside * a and any(q[1][i : i + len(w)] == w for i in range(len(q[1]))) for q, c in held.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        found.append((lang, -score, -a, " ".join(w), l, r))
    out = []
    for lang in n:
        for rank, (_, score, a, phrase, l, r) in enumerate(sorted((x for x in found if x[0] == lang), key=lambda x: (x[1], x[2], x[3].encode()))[:most], 1):
            out.append((lang, rank, phrase, -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    few = "the of and to in that is".split()
    out = [("en", ". ".join(" ".join(rng.choices(few, k=rng.randint(0, 9))) for _ in range(20))) for _ in range(60)]
    out += [(lang, prose(rng, 60).replace(" to ", ", ")) for lang in ("en", "de", None, "und") for _ in range(40)]
    out += [("en", "New  York\tCity is  big;NEW york city")] * 40
    out += [("de", None), ("en", ""), (None, " \n.,;\t "), ("en", "x"), ("en", "x " * 3000), ("de", "Ä é 漢字 🙂 漢字 🙂."), ("xx", "only one"), ("en", "a\x0bb\x0cc\rd\x01e f")]
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "k", "n") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, words int, phrase string, h string").repartition(5)


@pytest.mark.parametrize("budget", [1 << 19, 200, 7])
def test_counts_at_any_budget(spark, rows, budget):
    docs = table_of(spark, [(lang or "und", t) for lang, t in rows if t]).select("lang", "text")
    phrases, totals = phrase_counts(docs, least=5, budget=budget)
    found = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in phrases.collect()}
    assert found == {k: c for k, c in counted(rows).items() if c >= 5}
    assert {r.lang for r in totals.collect()} == {"en", "de", "und", "xx"}


@pytest.mark.parametrize("most", [2000, 9])
def test_ranks(spark, rows, most):
    assert sorted(map(tuple, collocations(table_of(spark, rows), least=20, most=most, budget=500).collect())) == brute(rows, 20, most)


def test_other_depth_and_share(spark, rows):
    assert sorted(map(tuple, collocations(table_of(spark, rows), least=10, depth=3, inside=50).collect())) == brute(rows, 10, 2000, 3, 50)


def test_empty(spark, rows):
    assert collocations(table_of(spark, rows).limit(0)).collect() == []
    assert collocations(table_of(spark, [("en", None), (None, "")])).collect() == []


def test_long_texts_are_taken_in_stretches(monkeypatch):
    text = b"A b.c  d\t e\n" * 500 + b"z" * 3000 + b" end"
    whole = b"\n".join(pieces([text, b"", b" . "]))
    monkeypatch.setattr(co, "STRETCH", 64)
    assert b"\n".join(pieces([text, b"", b" . "])) == whole and len(list(pieces([text]))) > 50
    assert whole.split(b"\n")[:3] == [b"a b", b"c d e", b"a b"]


def test_hashes_that_meet_take_another_seed(spark, monkeypatch):
    """With a hash under which words meet, the first seeds are given up."""
    seen = []
    real = co.word_counts

    def meeting(docs, seed):
        seen.append(seed)
        counts = real(docs, seed)
        return counts.withColumn("h", counts.h % 2) if seed < 2 else counts

    monkeypatch.setattr(co, "word_counts", meeting)
    rows = [("en", "one two three")] * 5
    phrases, _ = phrase_counts(table_of(spark, rows).select("lang", "text"), least=5)
    assert seen == [0, 1, 2] and phrases.count() == 6


def test_equal_hashes_in_a_batch_are_not_merged():
    words = co.Words(b"a b c\nd e", 0)
    assert words.last.tolist() == [2, 2, 2, 4, 4]
    assert words.key(np.array([0]), 2) != words.key(np.array([1]), 2)

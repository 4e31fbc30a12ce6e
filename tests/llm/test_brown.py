import math
import zlib
from collections import Counter

import numpy as np
import pytest

from matchlake.llm import brown
from matchlake.llm.common import words


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


@pytest.mark.parametrize("known", [brown.KNOWN, 20])
def test_base_and_counts(docs, corpus, known):
    got = Counter()
    scores = []
    for r in brown.scored(*brown.fitted(docs, rounds=2, known=known)).collect():  # with 20 most words are joined
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
        scores.append(r.score)
    train = [t for i, t in corpus if not held(i)]
    c = Counter(w for t in train for w in words(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = Counter()
    for i, t in corpus:
        w = words(t)
        base = sum(math.log10((k + 0.1) / (n + 0.1 * (v + 1))) for k in [*(c[x] for x in w), len(train)])
        want[i, held(i), len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    assert got == want
    assert all(math.isfinite(s) and s < 0 for s in scores)


@pytest.mark.parametrize("known", [brown.KNOWN, 60])
def test_scores_by_the_definition(docs, corpus, known):
    """Scores from the tables of classes and transitions, token by token; words beyond the known ones are placed as well."""
    codes, lexicon, model = brown.fitted(docs, rounds=2, seen=5, own_units=40, known=known)
    own = {bytes(r["word"]): (r["n"], r["class"]) for r in model.vocabulary.collect()}
    train = [words(t) for i, t in corpus if not held(i)]
    count = Counter(w for t in train for w in t)
    assert {w: n for w, (n, _) in own.items()} == count
    ranked = sorted(count, key=lambda w: (-count[w], w))[:40]
    unit = lambda w: ranked.index(w) if w in ranked else 40 + brown.ending(w)
    before = lambda w: brown.END_CLASS if w is None else int(model.before[unit(w)])
    of = lambda w: own[w][1] if w in own else before(w)
    pairs = np.zeros_like(model.pairs)
    for t in train:
        for a, b in zip([None, *t], [*t, None]):
            pairs[before(a), brown.END_CLASS if b is None else of(b)] += 1
    assert np.allclose(pairs, model.pairs)
    step, size = brown.transitions(pairs), Counter()
    for w, (n, k) in own.items():
        size[k] += n
    for k in range(brown.CLASSES):  # the known words of a class and the slot of the unknown ones
        if size[k]:
            assert abs(sum((n - model.discount) / size[k] for n, c in own.values() if c == k) + 10 ** model.log_unknown[k] - 1) < 1e-9
    rare = [w for w in own if own[w][0] < 5]
    assert rare and all(own[w][1] == before(w) for w in rare)
    assert any(own[w][1] != before(w) for w in own if own[w][0] >= 5 and w not in ranked)
    want = Counter()
    for i, t in corpus:
        score = known_score = 0.0
        for a, b in zip([None, *words(t)], [*words(t), None]):
            k = brown.END_CLASS if b is None else of(b)
            p = step[before(a), k]
            if b is not None:
                p += math.log10((own[b][0] - model.discount) / size[k]) if b in own else model.log_unknown[k]
            score += p
            known_score += p * (b is None or b in own)
        want[i, round(score, 4), round(known_score, 4)] += 1
    got = Counter((r.doc_id, round(r.score, 4), round(r.known_score, 4)) for r in brown.scored(codes, lexicon, model).collect())
    assert got == want


def test_words_join_those_of_like_surroundings(spark):
    """Rarer words, no units of their own, go to the class of the frequent ones that stand in the same places, whatever their endings."""
    rng = np.random.default_rng(4)
    kinds = [[f"{k}{'xyzq'[i % 4]}{i}" for i in range(12)] for k in "abc"]
    rare = [[f"rare{k}{i}" for i in range(6)] for k in "abc"]
    rows = [(d, " ".join((rare if rng.random() < 0.05 else kinds)[i % 3][rng.integers(6)] for i in range(60))) for d in range(400)]
    _, _, model = brown.fitted(spark.createDataFrame(rows, "doc_id long, text string"), rounds=6, seen=20, own_units=18)
    own = {bytes(r["word"]).decode(): r["class"] for r in model.vocabulary.collect()}
    of = [{own[w] for w in k if w in own} for k in kinds]
    assert sum(own[w] in of[k] and not any(own[w] in of[j] for j in range(3) if j != k) for k in range(3) for w in rare[k]) >= 14


def test_probabilities_sum_to_one():
    pairs = np.random.default_rng(0).integers(0, 50, (brown.CLASSES + 1, brown.CLASSES + 1)).astype(float)
    assert np.allclose((10 ** brown.transitions(pairs)).sum(axis=1), 1)
    assert np.allclose((10 ** brown.transitions(np.zeros_like(pairs))).sum(axis=1), 1)


def test_classes_beat_single_words(spark):
    rng = np.random.default_rng(2)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abc"]
    rows = [(d, " ".join(kinds[i % 3][rng.integers(30)] for i in range(60))) for d in range(200)]
    got = brown.class_scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=6).filter("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_empty(empty):
    assert brown.class_scores(empty, rounds=1).collect() == []

"""Substring dedup: the index against counting by hand, whole tables against a dictionary of all windows."""

import random

import numpy as np
import pytest
import zstandard

from matchlake.llm import substring
from matchlake.llm.substring import FMIndex, Merger, Segments, drop_repeats, repeats
from tests.llm.conftest import prose


def brute(rows, window=13):
    """(id, n_words, n_removed, kept) by a dictionary of the least id of every window."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in split:
        for a in range(len(w) - window + 1 if i is not None else 0):
            k = tuple(w[a : a + window])
            least[k] = min(i, least.get(k, i))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[a : a + window])] < i:
                gone |= set(range(a, a + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def same(found, rows, window=13):
    key = lambda r: str(r)
    assert sorted((tuple(r[:4]) for r in found), key=key) == sorted(brute(rows, window), key=key)


def test_backward_search_counts(seed=3):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(1, 6, 700), 0)
    text[::90] = 0
    index = FMIndex(text, 8)
    for _ in range(300):
        a, n = rng.integers(0, 680), rng.integers(1, 9)
        want = text[a : a + n].tolist()
        if 0 in want:
            continue
        low, high = index.first[want[-1]], index.first[want[-1] + 1]
        for w in want[-2::-1]:
            low, high = (int(x[0]) for x in index.back(np.array([w]), np.array([low]), np.array([high])))
        there = [p for p in range(len(text) - n + 1) if text[p : p + n].tolist() == want]
        assert sorted(index.suffixes[low:high].tolist()) == there


def test_shard_against_all_windows():
    rng = random.Random(5)
    base = prose(rng, 60).split()
    rows = []
    for i in range(200):
        a, n = rng.randrange(30), rng.randint(13, 30)
        rows.append((rng.randrange(40), " ".join(base[a : a + n] + prose(rng, rng.randint(0, 5)).split())))
    ids = np.array([i for i, _ in rows])
    gone = [set() for _ in rows]
    for k, a, b in zip(*repeats([t.encode() for _, t in rows], ids)):
        gone[k] |= set(range(a, b))
    assert [len(g) for g in gone] == [r[2] for r in brute(rows)]


def test_segments_hold_every_window_once():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(50)] + ["x " * 300, None, ""]
    for frequent in (np.zeros(0, np.int64), Segments(texts, np.zeros(0, np.int64)).key[::3]):
        found = Segments(texts, np.sort(frequent))
        windows = sorted((o, p) for o, a, b in zip(found.own, found.first, found.last) for p in range(a, b - 12))
        n = [len(substring.split_words(t)) for t in texts]
        assert windows == [(o, found.before[o] + p) for o in range(len(texts)) for p in range(n[o] - 12)]


def test_merger_sends_the_least_id_once():
    m = Merger(3)
    for doc_id, start in ((5, 0), (7, 3), (2, 1), (2, 9), (9, 0)):
        m.add(b"a b", 2, 77, 0, doc_id, doc_id, start)
    packed, known = (x.to_pylist() for x in m.send())
    (row,) = packed
    rows, starts, key = substring._unpack(row["numbers"])
    assert rows.T.tolist() == [[0, 2, 2, 2]] and starts.tolist() == [1, 9] and key.tolist() == [77 >> 2]
    assert zstandard.decompress(row["texts"]) == b"a b" and row["bucket"] == 77 % 3
    assert sorted((r["at"], r["start"], r["stop"]) for r in known) == [(5, 0, 2), (7, 3, 5), (9, 0, 2)]
    m.add(b"a b", 2, 77, 0, 8, 8, 4)
    assert [(r["at"], r["start"], r["stop"]) for x in m.send() for r in x.to_pylist()] == [(8, 4, 6)]


def test_corpus_against_all_windows(spark, docs, corpus):
    found = drop_repeats(docs, carry=("fp", "row")).collect()
    same(found, corpus)
    assert sum(r.n_removed > 0 for r in found) > 40
    assert {(r.fp, r.row) for r in found} == {("x", 1)}


def test_other_windows_and_tables(spark, docs, corpus, empty):
    same(drop_repeats(docs, window=5).collect(), corpus, 5)
    assert drop_repeats(empty).collect() == []
    short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    assert sorted(map(tuple, drop_repeats(short).collect())) == [(1, 2, 0, "a b"), (2, 0, 0, "")]


@pytest.mark.parametrize("bounds", [(1 << 12, 1 << 11, 1 << 12, 1 / 200), (1 << 20, 1, 1 << 14, 1 / 50)])
def test_hot_passage_in_small_shards(spark, monkeypatch, bounds):
    """A passage in each of many texts, ids in any order, several flushes and shards."""
    for name, value in zip(("MERGE_BYTES", "HELD_BYTES", "SHARD_BYTES", "FREQUENT"), bounds):
        monkeypatch.setattr(substring, name, value)
    rng = random.Random(11)
    passage, copy = prose(rng, 40), prose(rng, 120)
    rows = [(i, f"{prose(rng, rng.randint(0, 30))} {passage} {prose(rng, rng.randint(0, 30))}") for i in range(400)]
    rows += [(1000 + i, copy) for i in range(100)] + [(1000, copy), (None, copy), (77, copy)]
    rng.shuffle(rows)
    same(drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), rows)

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from matchlake.llm import simhash
from matchlake.llm.common import join_hot, words
from matchlake.llm.components import components
from matchlake.llm.shingles import shingle_hashes


def hashes(text, k):
    w = words(text)
    return [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text):
    h = hashes(text, 4)
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values, most):
    """Class number of each value by comparing all pairs."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_hashes(corpus):
    texts = [t for _, t in corpus]
    found, count = shingle_hashes(texts, 4)
    assert found.tolist() == [h for t in texts for h in hashes(t, 4)]
    assert count.tolist() == [len(hashes(t, 4)) for t in texts]


def test_classes_match_brute_force(spark, docs, corpus):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_classes(docs).collect())
    fps = [fingerprint(t) for _, t in corpus]
    of = brute_classes(fps, 4)
    least = {c: min((i for (i, _), k in zip(corpus, of) if k == c and i is not None), default=None) for c in of}
    assert got == Counter((i, f"{f:016x}", least[c]) for (i, _), f, c in zip(corpus, fps, of))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 3).tolist()
    values = sorted({b ^ sum(1 << int(x) for x in set(rng.integers(0, 63, rng.integers(0, 6)).tolist())) for b in base for _ in range(150)})
    fps = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(fps, 4).collect()}
    of = brute_classes(values, 4)
    least = {c: min(i for i, k in enumerate(of) if k == c) for c in of}
    assert got == {v: least[c] for v, c in zip(values, of)}


def test_block_keys_miss_no_link():
    rng = np.random.default_rng(5)
    for n in (100, 10**6, 10**9):
        sets = simhash.block_keys(n, 4)
        for _ in range(300):
            flips = set(rng.choice(64, 4, replace=False).tolist())
            assert any(all(not flips & set(range(shift, shift + width)) for shift, width in s) for s in sets)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}


def test_near_groups(spark, docs, corpus):
    group = {}
    for r in simhash.near_duplicate_groups(docs).collect():
        group.setdefault(r.doc_id, r.group_id)
    sets = {i: set(hashes(t, 5)) for i, t in corpus if i is not None}
    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            union = len(sets[a] | sets[b])
            similar = len(sets[a] & sets[b]) / union if union else 1.0
            if similar >= 0.8:
                assert group[a] == group[b]
    for i in range(60):  # prose of its own, but for number 6 that has edited copies
        if i > 6:
            assert group[i] == i


def test_near_groups_are_similar(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(11)
    texts = []
    for g in range(12):  # versions of a text at similarities from 0.6 to 0.95, beside a chain
        base = [f"g{g}w{i}" for i in range(400)]
        for k in range(12):
            own = list(base)
            for at in rng.choice(80, rng.integers(1, 20), replace=False).tolist():
                own[5 * at] = f"g{g}v{k}x{at}"
            texts.append(" ".join(own))
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(hashes(t, 5)) for t in texts]
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                of = [of[j] if x == of[i] else x for x in of]
    least = {c: of.index(c) for c in of}
    assert got == {i: least[c] for i, c in enumerate(of)}
    assert 12 < len(set(of)) < len(texts)


def test_recall_at_the_threshold(spark):
    """400 pairs of texts of a similarity of 0.80 to 0.82, no two pairs alike: at least 99 of 100 are found."""
    rng = np.random.default_rng(17)
    rows = []
    for g in range(400):
        base = [f"g{g}w{i}" for i in range(304 + int(rng.integers(100)))]
        other, changed, want = list(base), 0, int((len(base) - 4) * 0.111)  # changed shingles of n: (n - c) / (n + c)
        for at in rng.permutation(len(base) // 5)[: want // 5].tolist():
            other[5 * at + 2] = f"x{g}y{at}"
            changed += 1
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    sets = [set(hashes(t, 5)) for _, t in rows]
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert min(near) >= 0.8 and max(near) < 0.84
    got = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(400)) >= 396


def test_one_row_of_each_group_stays(spark, docs, corpus):
    own = docs.withColumn("mine", F.monotonically_increasing_id())
    got = simhash.near_duplicate_groups(own, row_col="mine").collect()
    assert len({r.row for r in got}) == len(got) == len(corpus)
    groups = {}
    for r in got:
        groups.setdefault(r.group_id if r.doc_id is not None else ("none", r.row), []).append(r)
    assert all(sum(r.stays for r in g) == 1 and min(r.doc_id for r in g) == next(r.doc_id for r in g if r.stays) for k, g in groups.items() if not isinstance(k, tuple))


def test_keys_of_many_rows_are_joined_apart(spark):
    left = spark.createDataFrame([(i % 7 if i % 10 else 3, i) for i in range(5000)] + [(None, -1), (10**6, -2)], "k long, v long")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(100)], "k long, w string")
    for how in ("inner", "left"):
        want, got = left.join(right, "k", how), join_hot(left, right, "k", how)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.columns == want.columns


def test_similar_at_the_threshold():
    for n in range(1, 300):
        assert simhash.similar(np.arange(5 * n), np.arange(n, 5 * n)) and not simhash.similar(np.arange(5 * n), np.arange(n + 1, 5 * n))


def test_empty(spark, empty):
    assert simhash.simhash_classes(empty).collect() == []
    assert simhash.near_duplicate_groups(empty).collect() == []


def test_large_buckets_are_dealt_out_by_further_bits(spark, monkeypatch):
    """Fingerprints that agree in all but 28 bits: the same classes as by brute force, with rows in proportion."""
    from matchlake.llm import simhash as sh

    rng = np.random.default_rng(12)
    values = np.unique(rng.integers(0, 1 << 28, 3000)) << 20
    values = np.unique(np.concatenate([values, values[:300] ^ (1 << 21), values[:100] ^ (0b111 << 40)]))
    rows = [(i, int(v)) for i, v in enumerate(values)]
    monkeypatch.setattr(sh, "LARGE", 200)
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in sh.classes(fps).collect()}
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None], len(values)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert got == {int(v): int(x) for v, x in zip(values, label)}


def test_rows_of_a_large_bucket_grow_in_proportion(spark, monkeypatch):
    from matchlake.llm import simhash as sh

    monkeypatch.setattr(sh, "LARGE", 100)
    sets = sh.block_keys(1, 4)
    low, width = [r for r in sorted({r for s in sets for r in s}) if r not in sets[0]][0]
    made = []
    for n in (2000, 8000):
        values = np.random.default_rng(n).integers(0, 1 << 40, n) << low
        keyed = spark.createDataFrame([(5, 0, int(v), [int(v)]) for v in np.unique(values)], "bucket long, number int, node long, fp array<long>")
        split = sh.split_large(keyed, sets, 4)
        made.append((split.count() / keyed.count(), split.groupBy("bucket").count().agg({"count": "max"}).first()[0]))
    assert made[0][0] == made[1][0] == 70 and made[1][1] < 400

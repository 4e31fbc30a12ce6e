import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from matchlake.llm import quality as ql
from tests.llm.conftest import prose


def labelled(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        good = i % 6 != 0
        text = prose(rng, rng.randint(20, 120)) if good else rng.choice(["BUY!! NOW!! " * rng.randint(5, 40), "### $$$ " * 30, "spam spam " * rng.randint(9, 60)])
        rows.append((i, text, 7))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), "x"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, score long"), labels, spark.createDataFrame(labels, "doc_id long, quality int, text string")


def test_held_out_accuracy(spark):
    rows, docs, labels, table = labelled(spark)
    got = {r.doc_id: r for r in ql.quality_scores(docs, table).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q, _ in labels if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.9


def test_held_out_labels_are_not_learned(spark):
    _, docs, labels, table = labelled(spark)
    other = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels], table.schema)
    a, b = ({r.doc_id: r.score for r in ql.quality_scores(docs, t).collect()} for t in (table, other))
    assert a == b


def test_prior_estimate():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for prior in (0.3, 0.6, 0.9):
        mixed = np.concatenate([good[: int(2000 * prior)], bad[: 2000 - int(2000 * prior)]])
        at = ql.thresholds(good[2000:])
        reached = [np.bincount(np.searchsorted(at, x, "right"), minlength=len(at) + 1) for x in (good[2000:], mixed)]
        assert abs(ql.class_prior(*reached) - prior) < 0.08


def risk(theta, p, u, prior):
    """The non-negative risk, written out."""
    loss = lambda rows, sign: sum(math.log1p(math.exp(-sign * (sum(a * b for a, b in zip(x, theta)) + theta[-1]))) for x in rows) / len(rows)
    return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)


def test_gradient_is_that_of_the_risk():
    rng = np.random.default_rng(3)
    signs = set()
    for prior, shift in ((0.3, 1.0), (0.9, 4.0)):
        x = rng.normal(0, 1, (60, len(ql.FEATURES)))
        model = ql.Model(x)
        p, u = model.wide(x[:25] + shift).astype(np.float64), model.wide(x[25:]).astype(np.float64)
        theta = rng.normal(0, 0.05, p.shape[1] + 1)
        theta[-1] = shift - 2
        got = model.gradient(theta, p.astype(np.float32), u.astype(np.float32), prior)
        positive, negative = risk(theta, p.tolist(), u.tolist(), prior)
        signs.add(negative >= 0)
        for i in (0, 7, 50, len(theta) - 1):
            step = np.zeros_like(theta)
            step[i] = 1e-5
            up, down = (risk(theta + s, p.tolist(), u.tolist(), prior) for s in (step, -step))
            slope = [(a - b) / 2e-5 for a, b in zip(up, down)]
            want = slope[0] + slope[1] if negative >= 0 else -slope[1]
            assert abs(got[i] - want) < 1e-3 * max(1, abs(want)), (i, got[i], want)
    assert signs == {True, False}


def test_ties_and_rows(spark):
    """Equal texts have equal scores whatever their ids; row_col is returned as it is."""
    rows, docs, labels, table = labelled(spark)
    twice = docs.unionByName(docs).withColumn("mine", F.struct(F.monotonically_increasing_id().alias("a"), F.lit(1).alias("b")))
    got = ql.quality_scores(twice, table, row_col="mine").collect()
    assert len({r.row for r in got}) == len(got) == 2 * len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict((i, t) for i, t, _ in rows)[r.doc_id] if r.doc_id < 40 else r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())


def test_edges(spark, docs, empty, corpus):
    none = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, quality int")
    assert {r.score for r in ql.quality_scores(docs, none).collect()} == {0.5}
    assert ql.quality_scores(empty, none).collect() == []
    some = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    assert ql.quality_scores(docs, some).count() == len(corpus)
    assert ql.describe(None) == ql.describe("") == [0.0] * len(ql.FEATURES)

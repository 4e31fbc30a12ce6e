import os
import random

import corpus_pipeline as cp
from matchlake.llm.common import stored
from tests.llm.conftest import prose


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    item = prose(rng, 40)
    rows = [(i, prose(rng, rng.randint(40, 120)), 0) for i in range(300)]
    rows += [(1000 + i, rows[i][1], 0) for i in range(20)]  # exact copies
    rows += [(1100 + i, " ".join(w if j != 20 else "otherwise" for j, w in enumerate(rows[i][1].split())), 0) for i in range(20, 60) if len(rows[i][1].split()) > 80]
    rows += [(1200 + i, prose(rng, 30) + " " + item + " " + prose(rng, 30), 0) for i in range(8)]
    rows += [(1300 + i, prose(rng, 60) + "\nRead the rest of this page here\n" + prose(rng, 30), 0) for i in range(12)]
    rows += [(1400 + i, "BUY!! NOW!! CHEAP!! " * rng.randint(10, 40), 0) for i in range(60)]
    rows += [(5, rows[5][1], 0)]
    labels = [(i, 1) for i in range(0, 300, 2)] + [(1400 + i, 0) for i in range(0, 60, 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumnRenamed("n_chars", "n_chars").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "n_chars", "1 AS score", "2 AS predicted").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = docs.columns
        docs = stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == before
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    assert not [i for i in ids["quality"] if 1400 <= i < 1500]
    assert len([i for i in ids["quality"] if i < 300]) >= 295
    assert not [r for r in seen["line_dedup"] if "rest of this page" in r.text] and ids["line_dedup"] == ids["quality"]
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    near = ids["near_dedup"]
    assert not [i for i in near if 1000 <= i < 1200] and len(seen["near_dedup"]) == len(near)
    assert os.path.isdir(f"{tmp_path}/documents.parquet")
    assert {i for i in ids["line_dedup"] if i < 300} <= near
    assert {i for i in near if i not in ids["decontaminate"]} == {i for i in near if 1200 <= i < 1300}
    assert ids["packing"] == ids["decontaminate"]
    assert cp.run(spark, str(tmp_path)).count() == len(seen["packing"])


def test_rows_without_ids_of_their_own(spark, tmp_path):
    """Null ids and ids that stand for several texts: each row stays or goes by its own text."""
    rng = random.Random(14)
    good = [prose(rng, 60) for _ in range(120)]
    item = prose(rng, 40)
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(None, prose(rng, 50)), (None, f"{prose(rng, 20)} {item}"), (None, good[3]), (None, None), (None, ""), (500, None)]
    rows += [(7, prose(rng, 55)), (7, good[7]), (8, f"{item} {prose(rng, 30)}"), (None, "BUY!! NOW!! " * 40)]
    rows += [(1400 + i, "BUY!! NOW!! CHEAP!! " * rng.randint(10, 40)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS row", "1 AS node").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = stored(cp.near_dedup(spark, docs, str(tmp_path)), "t")
    assert near.columns == docs.columns
    kept = near.collect()
    texts = [r.text or "" for r in kept]
    assert len(set(texts)) == len(texts) == len({t or "" for _, t in rows}) - len({t for i, t in rows if i and i >= 1400 or (t or "").startswith("BUY")}) + len([t for t in texts if t.startswith("BUY")])
    assert {r.doc_id for r in kept if r.text == good[3]} == {3} and {r.text for r in kept if r.doc_id == 7} == {good[7], rows[126][1]}
    assert [r.doc_id for r in kept if not r.text] == [500]
    clean = stored(cp.decontaminate(spark, near, str(tmp_path)), "t")
    assert [r for r in clean.collect() if item in (r.text or "")] == [] and clean.count() == near.count() - 2
    assert {r.text for r in clean.collect() if r.doc_id == 8} == {good[8]}
    rated = cp.quality(spark, docs, str(tmp_path)).collect()
    assert not [r for r in rated if (r.text or "").startswith("BUY")] and len([r for r in rated if r.doc_id is None and r.text]) >= 2
    assert cp.run(spark, str(tmp_path)).count() > 100


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []

"""The Python data sources: pruning, broken lines, and batches appended once."""

import json

import pytest
from pyspark.sql import functions as F

from matchlake.sources import bodies


@pytest.fixture()
def folder(spark, tmp_path):
    bodies.register(spark)
    for match in range(6):
        own = tmp_path / "in" / f"match_id={match}"
        own.mkdir(parents=True)
        lines = [json.dumps({"frame_seq": f, "predictions": [{"x": f, "y": 2.5, "class_id": match, "confidence": 0.5}] * (f % 3)}) for f in range(4)]
        (own / "a.txt").write_text("\n".join([*lines, "", "{broken", "[]", '{"predictions": []}']))
    (tmp_path / "in" / "_SUCCESS").write_text("")
    return str(tmp_path / "in")


def test_rows_of_all_bodies(spark, folder):
    rows = spark.read.format("prediction_bodies").load(folder)
    got = sorted((r.match_id, r.frame_seq, r.det_ord, r.x, r.class_id) for r in rows.filter("match_id = 3").collect() if r.det_ord is not None)
    assert got == [(3, 1, 0, 1.0, 3), (3, 2, 0, 2.0, 3), (3, 2, 1, 2.0, 3)]
    assert rows.filter("det_ord IS NULL").count() == 12 and rows.count() == 30


def test_filters_choose_folders(spark, folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, In, LessThan

    reader = bodies.BodyReader(folder)
    rest = list(reader.pushFilters([LessThan(("match_id",), 4), In(("match_id",), (1, 3, 5)), EqualTo(("frame_seq",), 2)]))
    assert rest == [EqualTo(("frame_seq",), 2)]
    assert [m for p in reader.partitions() for m, _ in p.files] == [1, 3]
    monkeypatch.setattr(bodies, "PART_BYTES", 1)
    assert len(bodies.BodyReader(folder).partitions()) == 6
    chosen = spark.read.format("prediction_bodies").load(folder).filter("match_id = 2 AND frame_seq = 1")
    assert [(r.match_id, r.frame_seq) for r in chosen.collect()] == [(2, 1)] and chosen.rdd.getNumPartitions() == 1


def test_files_grow_with_bodies_and_not_with_matches(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    bodies.register(spark)
    m = F.when(F.col("id") < 2000, F.col("id") - 500)
    p = F.struct(F.lit(1.5).alias("x"), m.alias("class_id"))
    ours = spark.range(2001).select(m.alias("match_id"), F.lit(7).alias("frame_seq"), F.when(F.col("id") % 5 > 0, F.array(p, p)).alias("predictions"))
    bodies.written(ours, str(tmp_path / "out"))
    assert sum(1 for f in (tmp_path / "out").rglob("*.txt")) <= bodies.GROUPS + 8
    rows = spark.read.format("prediction_bodies").load(str(tmp_path / "out"))
    expected = ours.select("match_id", F.col("frame_seq").cast("long"), F.posexplode_outer("predictions").alias("det_ord", "p")).select("match_id", "frame_seq", "det_ord", "p.class_id", "p.x")
    got = rows.select("match_id", "frame_seq", "det_ord", "class_id", "x")
    assert got.count() == expected.count() == 3601 and got.exceptAll(expected).count() == 0
    assert sorted((r.match_id, r.det_ord) for r in rows.filter("match_id IN (-3, 12, 268) AND match_id > -9 AND class_id <> 99").collect()) == [(-3, 0), (-3, 1), (12, 0), (12, 1), (268, 0), (268, 1)]
    assert rows.filter("match_id < 0").count() == expected.filter("match_id < 0").count()
    reader = bodies.BodyReader(str(tmp_path / "out"))
    assert list(reader.pushFilters([In(("match_id",), (-3, 12, 268)), GreaterThan(("match_id",), 0), EqualTo(("match_id",), 268)])) == []
    assert {f.split("match_group=")[1].split("/")[0] for p in reader.partitions() for _, f in p.files} == {"12-of-256"}
    assert [r for p in reader.partitions() for b in reader.read(p) for r in b.column("match_id").to_pylist()] == [268, 268]


def test_lines_over_chunks():
    import io

    text = b"ab\r\ncdefg\n\nhi"
    for size in range(1, 20):
        assert [x.strip() for x in bodies._lines(io.BytesIO(text), size) if x.strip()] == [b"ab", b"cdefg", b"hi"]


def test_batches_are_appended_once(spark, tmp_path):
    bodies.register(spark)
    path = str(tmp_path / "log")
    rows = spark.range(100).select("id", F.col("id").alias("at"), F.lit("done").alias("action")).repartition(4)
    put = lambda df, batch: df.write.format("audit_log").option("batch", batch).mode("append").save(path)
    failing = rows.withColumn("action", F.when((F.col("id") == 77), F.raise_error(F.lit("task fails")).cast("string")).otherwise(F.col("action")))
    with pytest.raises(Exception, match="task fails"):
        put(failing, "one")
    assert spark.read.format("audit_log").load(path).count() == 0
    put(rows, "one")
    put(rows, "one")
    put(rows.filter("id < 5"), "two")
    assert spark.read.format("audit_log").load(path).count() == 105
    with pytest.raises(Exception, match="only appended"):
        rows.write.format("audit_log").option("batch", "x").mode("overwrite").save(path)


def test_a_task_that_ran_twice_counts_once(tmp_path):
    from pyspark.sql import Row

    writer = bodies.AuditWriter(str(tmp_path), "b")
    row = Row(id=1, at=2, action="x")
    writer.write(iter([row]))  # an attempt that is lost
    kept = writer.write(iter([row]))
    writer.commit([kept, None, bodies.Written(None, 0)])
    reader = bodies.AuditReader(str(tmp_path))
    assert [r for p in reader.partitions() for r in reader.read(p)] == [(1, 2, "x")]

"""Streams fed in several batches."""

import json

from matchlake.operators import docs
from matchlake.streaming import triggers


def test_uploads_start_once(spark, tmp_path):
    matches = spark.createDataFrame([(1, 5, "uploading"), (2, 5, "processing")], "id long, user_id long, status string")
    inbox = tmp_path / "in"
    inbox.mkdir()
    seen = []
    handle = lambda batch, _: seen.extend(r.id for r in batch.collect())
    rows = [("videos/5/1/a.mp4", 10), ("videos/5/2/a.mp4", 10), ("videos/5/1/b.txt", 10), ("images/5/1/a.mp4", 10), ("videos/5/1/c.mp4", 600 << 20)]
    (inbox / "a.json").write_text("\n".join(json.dumps({"path": p, "content_type": "x", "size": n}) for p, n in rows))
    triggers.on_upload(spark, str(inbox), matches, handle, str(tmp_path / "marks")).awaitTermination()
    assert seen == ["1"]
    triggers.on_upload(spark, str(inbox), matches, handle, str(tmp_path / "marks")).awaitTermination()
    assert seen == ["1"]


def test_transitions_over_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    schema = "id long, at long, status string"
    batches = [[(1, 1, "processing"), (2, 1, "completed")], [(1, 2, "completed"), (2, 2, "completed")], [(1, 3, "error"), (1, 4, "completed")]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    got = sorted(tuple(r) for r in triggers.drained(triggers.transitions(stream, "completed")).collect())
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    want = sorted((r.id, r.at, r.was) for r in docs.transitions(whole, "completed").collect())
    assert want == [(1, 2, "processing"), (1, 4, "error")]
    assert got == want


def test_append_and_create(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",)], "kind string")
    for _ in range(2):
        docs.append(rows, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 4
    made = docs.created(rows).collect()
    assert len({r.id for r in made}) == 2 and all(r.created_at for r in made)


def test_updates_over_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    schema = "id long, at long, status string"
    for b in ([(1, 1, "uploading"), (2, 1, "uploading")], [(1, 2, "processing")], [(1, 3, "completed"), (3, 3, "error")]):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(inbox))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox))
    got = sorted((r.id, r.status, r.at) for r in triggers.drained_updates(triggers.live_documents(stream), "id").collect())
    assert got == [(1, "completed", 3), (2, "uploading", 1), (3, "error", 3)]


def test_uploads_are_written_with_their_audit_rows(spark, tmp_path):
    matches = spark.createDataFrame([(1, 5, "uploading"), (2, 6, "uploading")], "id long, user_id long, status string")
    inbox = tmp_path / "in"
    inbox.mkdir()
    handle = triggers.start_processing(str(tmp_path / "updates"), str(tmp_path / "audit"))
    for n, path in enumerate(("videos/5/1/a.mp4", "videos/6/2/b.mp4")):
        (inbox / f"{n}.json").write_text(json.dumps({"path": path, "content_type": "x", "size": 10}))
        triggers.on_upload(spark, str(inbox), matches, handle, str(tmp_path / "marks")).awaitTermination()
    handle(triggers.accepted_uploads(spark.createDataFrame([("videos/6/2/b.mp4", "x", 10)], triggers.UPLOADS), matches), 1)  # run again
    started = spark.read.parquet(str(tmp_path / "updates")).collect()
    assert sorted((r.id, r.status, r.video_url) for r in started) == [("1", "processing", "videos/5/1/a.mp4"), ("2", "processing", "videos/6/2/b.mp4")]
    assert sorted((r.id, r.action) for r in spark.read.parquet(str(tmp_path / "audit")).collect()) == [("1", "processing_started"), ("2", "processing_started")]

"""Streams with held rows: order, lateness, replay and listeners."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from matchlake import scratch
from matchlake.operators import docs, stats
from matchlake.plans.profiles import ELEVEN
from matchlake.streaming import stateful


def at(s):
    return dt.datetime.fromtimestamp(1_700_000_000 + s, dt.timezone.utc)


CHANGES = "id long, at long, status string, ts timestamp"


def test_changes_out_of_order_and_stuck(spark):
    rows = [(1, 1, "processing", at(0)), (1, 3, "completed", at(500)), (1, 2, "error", at(20)), (2, 1, "processing", at(5)), (2, 2, "processing", at(7000)), (2, 3, "completed", at(7001)), (3, 1, "completed", at(9)), (4, 1, "processing", at(7100)), (5, 1, None, at(3)), (5, 2, "completed", at(4))]
    changes = spark.createDataFrame(rows, CHANGES)
    parts = [F.col("at") == 3, F.col("at") == 2, F.col("at") == 1]
    got = stateful.run_to_end(stateful.watched(stateful.in_parts(changes, parts, key="id"), "completed", "processing", 3600, "3 hours"))
    want = [(1, 3, "completed", "error"), (2, 1, "stuck", None), (2, 3, "completed", "processing"), (4, 1, "stuck", None)]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, stateful.watched_batch(changes, "completed", "processing", 3600).collect()), key=str) == want


def test_late_changes_are_dropped(spark):
    """What comes after the watermark has passed it changes nothing, be it the change before or the one after."""
    changes = spark.createDataFrame([(1, 1, "processing", at(5000)), (1, 2, "completed", at(4000)), (1, 3, "error", at(5001)), (1, 4, "completed", at(5002))], CHANGES)
    stream = stateful.watched(stateful.in_parts(changes, [F.col("at") == 1, F.col("at") == 2, F.col("at") > 2], key="id"), "completed", "uploading", 60, "10 seconds")
    assert sorted(map(tuple, stateful.run_to_end(stream).collect())) == [(1, 4, "completed", "error")]


def test_late_rows_of_windows_are_counted(spark):
    changes = spark.createDataFrame([(1, "home", at(5000)), (1, "away", at(41)), (1, "home", at(5001))], "match_id long, team_side string, ts timestamp")
    parts = [F.col("ts") == F.lit(at(5000)), F.col("ts") == F.lit(at(5001)), F.col("ts") == F.lit(at(41))]  # rows are late by the watermark of the batch before
    query = stateful.minute_counts(stateful.in_parts(changes, parts), "10 seconds").writeStream.format("noop").option("checkpointLocation", scratch.folder(spark, "marks")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators) == 1


def test_steps_hold_frames_until_their_turn(spark):
    schema = "match_id long, frame_seq long, owner string, x double, y double, near boolean, ts timestamp"
    rows = [(1, f, "home" if f % 3 else None, float(f * f), 0.0, f in (2, 4, 10), at(5 * f)) for f in range(12)]
    frames = spark.createDataFrame(rows, schema)
    parts = [F.col("frame_seq") % 3 == 2, F.col("frame_seq") % 3 == 0, F.col("frame_seq") % 3 == 1]
    got = sorted(map(tuple, stateful.run_to_end(stateful.held_steps(stateful.in_parts(frames, parts, key="match_id"), 5, "5 minutes")).collect()))
    assert got == [(1, f, None if f == 0 else rows[f - 1][2], None if f == 0 else float(f * f - (f - 1) ** 2), f in (2, 10)) for f in range(12)]


def test_minutes_are_closed_at_both_ends(spark):
    rows = [(1, "home", at(40)), (1, "away", at(41)), (1, "home", at(160)), (1, "away", at(280))]  # 1,700,000,040 is a whole number of two minutes
    changes = spark.createDataFrame(rows, "match_id long, team_side string, ts timestamp")
    stream = stateful.minute_counts(stateful.in_parts(changes, [F.lit(True)], key="match_id"), "1 minute")
    base = 1_700_000_040 // 60
    got = sorted((r.minute - base, r.n_home, r.n) for r in stateful.run_to_end(stream).filter("match_id >= 0").collect())
    assert got == [(0, 1, 1), (2, 2, 3), (4, 1, 2), (6, 0, 1)]
    shares = stats.momentum_shares(spark.createDataFrame([(1, 2, 2, 3)], "match_id long, minute long, n_home long, n long"), spark.createDataFrame([(1, 200.0)], "match_id long, duration double"), ELEVEN)
    assert sorted(map(tuple, shares.collect())) == [(1, 0, 0.0, 100.0), (1, 2, 66.7, 33.3), (1, 4, 0.0, 100.0)]


def test_uploads_start_once_over_repeats_and_replays(spark):
    matches = spark.createDataFrame([(1, 5, "uploading"), (2, 5, "uploading"), (3, 6, "processing")], "id long, user_id long, status string")
    files = "path string, content_type string, size bigint"
    folder = scratch.folder(spark, "starts")
    handle = stateful.starting(matches, folder)
    batch = lambda *paths: spark.createDataFrame([(p, "video/mp4", 1) for p in paths], files)
    first, second = batch("videos/5/1/b.mp4", "videos/5/1/a.mp4", "videos/6/3/a.mp4"), batch("videos/5/1/c.mp4", "videos/5/2/a.mp4")
    for b, n in ((first, 0), (second, 1), (first, 0), (second, 1)):
        handle(b, n)
        read = lambda what: sorted((r.id, r[1], r.batch) for r in spark.read.option("basePath", f"{folder}/{what}").parquet(f"{folder}/{what}").select("id", "video_url" if what == "started" else "detail", "batch").collect())
    assert read("started") == read("audit") == [("1", "videos/5/1/a.mp4", 0), ("2", "videos/5/2/a.mp4", 1)]


def test_uploads_of_any_age_come_through_once(spark):
    rows = spark.createDataFrame([("a", at(90 * 86400), 0), ("b", at(0), 1), ("a", at(0), 1), ("b", at(1), 2), ("c", at(2), 2)], "path string, ts timestamp, part int")
    stream = stateful.new_uploads(stateful.in_parts(rows, [F.col("part") == i for i in range(3)]))
    assert sorted((r.path, r.part) for r in stateful.run_to_end(stream).collect()) == [("a", 0), ("b", 1), ("c", 2)]


def test_parts_are_written_and_read_by_all_cores(spark):
    rows = spark.range(1000, numPartitions=7).select(F.col("id").alias("v"))
    stream = stateful.in_parts(rows, ["v < 700", F.col("v") == 700, "v > 5000"])
    seen = stateful.progress_of(stream.observe("p", F.count(F.lit(1)).alias("n")), "p", "batch long, n long")
    assert sorted(map(tuple, seen.collect())) == [(0, 700), (1, 1), (2, 0)]
    own = [r["count"] for r in stateful.run_to_end(stream.withColumn("file", F.input_file_name())).groupBy("file").count().collect()]
    assert len(own) == spark.sparkContext.defaultParallelism + 1 and max(own) < 700


def test_a_failing_listener_does_not_stop_the_stream(spark):
    class Failing(StreamingQueryListener):
        def onQueryStarted(self, event):
            raise ValueError("started")

        def onQueryProgress(self, event):
            raise ValueError("progress")

        def onQueryIdle(self, event):
            raise ValueError("idle")

        def onQueryTerminated(self, event):
            raise ValueError("terminated")

    failing = Failing()
    spark.streams.addListener(failing)
    try:
        rows = spark.range(30).select(F.col("id").alias("v"))
        seen = stateful.in_parts(rows, [F.col("v") < 10, F.col("v") >= 10]).observe("p", F.count(F.lit(1)).alias("n"), F.max("v").alias("most"))
        got = sorted(map(tuple, stateful.progress_of(seen, "p", "batch long, n long, most long").filter("n > 0").collect()))
    finally:
        spark.streams.removeListener(failing)
    assert got == [(0, 10, 9), (1, 20, 29)]


def test_settings_and_folders_come_back(spark):
    before = spark.conf.get(stateful.STORE)
    path = scratch.folder(spark, "left")
    spark.range(3).write.parquet(path)
    with stateful.rocksdb(spark):
        assert spark.conf.get(stateful.STORE) == stateful.ROCKSDB
    assert spark.conf.get(stateful.STORE) == before and scratch.exists(spark, path)
    scratch.clear(spark)
    assert not scratch.exists(spark, path)


def test_merge_tells_null_from_absent(spark):
    doc = lambda rows: spark.createDataFrame(rows, "id long, text string").select("id", F.parse_json("text").alias("doc"))
    old = doc([(1, '{"a":1,"b":{"x":1}}'), (2, '{"a":2}'), (4, '{"a":null}')])
    new = doc([(1, '{"a":null,"b":{"y":2}}'), (3, '{"c":[1]}'), (4, "{}")])
    assert sorted((r.id, r.t) for r in docs.merged(old, new).select("id", F.to_json("doc").alias("t")).collect()) == [(1, '{"a":null,"b":{"y":2}}'), (2, '{"a":2}'), (3, '{"c":[1]}'), (4, '{"a":null}')]


def test_places_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = docs.placed(rows.repartition(7), "v").orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5001)) and [r.v for r in got] == sorted(r.v for r in got)
    assert docs.placed(rows.limit(0), "v").collect() == []


def test_only_owners_delete(spark):
    matches = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, user_id long")
    asked = spark.createDataFrame([(1, 5), (3, 5), (9, 9), (1, 5)], "id long, user_id long")
    files = spark.createDataFrame([("videos/5/1/a.mp4",), ("videos/5/12/a.mp4",), ("videos/6/3/a.mp4",), ("videos/6/1/a.mp4",), ("images/5/1/a",), ("x",)], "path string")
    audit = spark.createDataFrame([(1, "a"), (3, "b")], "match_id long, entry string")
    teams = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "id long, match_ids array<long>")
    left = docs.cascade(matches, asked, files, audit, teams)
    assert sorted(r.id for r in left["matches"].collect()) == [2, 3] and [r.match_id for r in left["audit"].collect()] == [3]
    assert sorted(r.path for r in left["files"].collect()) == ["images/5/1/a", "videos/5/12/a.mp4", "videos/6/1/a.mp4", "videos/6/3/a.mp4", "x"]
    assert {r.id: r.match_ids for r in left["teams"].collect()} == {1: [2, 3], 2: [], 3: None}


def test_members_given_as_rows_stay_rows(spark):
    matches = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, user_id long")
    asked = spark.createDataFrame([(1, 5), (3, 5)], "id long, user_id long")
    files, audit = spark.createDataFrame([], "path string"), spark.createDataFrame([], "match_id long, entry string")
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "id long, match_id long")
    assert sorted(map(tuple, docs.cascade(matches, asked, files, audit, rows)["teams"].collect())) == [(1, 2), (1, 3)]

"""Tracks on planted paths, against a plain version of the rules, and as a stream over any split into batches."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from matchlake.operators import tracking
from matchlake.plans import flows
from matchlake.streaming import stateful

SCHEMA = "match_id long, frame_seq long, det_ord long, class_id int, x double, y double, width double, height double, confidence double"


def iou(a, b):
    w = min(a[0] + a[2] / 2, b[0] + b[2] / 2) - max(a[0] - a[2] / 2, b[0] - b[2] / 2)
    h = min(a[1] + a[3] / 2, b[1] + b[3] / 2) - max(a[1] - a[3] / 2, b[1] - b[3] / 2)
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def plain(rows, r=tracking.Rules()):
    """(match, frame, det) -> track, one frame after the other with dictionaries."""
    out, tracks = {}, {}
    for match, frame in sorted({(x[0], x[1]) for x in rows}):
        dets = sorted(x for x in rows if x[:2] == (match, frame))
        live = tracks.setdefault(match, {"next": 0, "t": {}})
        live["t"] = {no: t for no, t in live["t"].items() if frame - t["seen"] <= r.buffer}
        guess = {no: (t["box"][0] + t["v"][0] * (frame - t["seen"]), t["box"][1] + t["v"][1] * (frame - t["seen"]), *t["box"][2:]) for no, t in live["t"].items()}
        free, mine = set(guess), {}
        for pick, least, only in ((lambda c: c >= r.sure, r.overlap, 0), (lambda c: r.least <= c < r.sure, r.overlap_unsure, 1)):
            may = [no for no in sorted(free) if not only or live["t"][no]["seen"] == frame - 1]
            pairs = sorted((-iou(guess[no], d[4:8]), no, k) for no in may for k, d in enumerate(dets) if pick(d[8]) and iou(guess[no], d[4:8]) >= least)
            for _, no, k in pairs:
                if no in free and k not in mine:
                    free.discard(no)
                    mine[k] = no
        for k, no in mine.items():
            t, d = live["t"][no], dets[k]
            v = [(d[4 + i] - t["box"][i]) / (frame - t["seen"]) for i in (0, 1)]
            t["v"] = v if t["v"] == [0, 0] else [(1 - r.momentum) * a + r.momentum * b for a, b in zip(t["v"], v)]
            t["box"], t["seen"] = d[4:8], frame
        for k, d in enumerate(dets):
            if d[8] >= r.sure and k not in mine:
                mine[k] = live["next"]
                live["t"][live["next"]] = {"box": d[4:8], "v": [0, 0], "seen": frame}
                live["next"] += 1
            out[(*d[:2], d[2])] = mine.get(k)
    return out


def crossing():
    """Two players who cross, one who is hidden for some frames, one seen faintly for a while; the order of boxes changes."""
    rng, rows, who = random.Random(4), [], {}
    for f in range(80):
        spots = {"a": (10 + 5 * f, 100 + f), "b": (410 - 5 * f, 180 - f), "c": (300, 20 + 2 * f), "d": (50 + f, 300)}
        seen = [p for p in spots if not (p == "c" and 30 <= f < 42)]
        rng.shuffle(seen)
        for k, p in enumerate(seen):
            rows.append((1, f, k, 2, *map(float, spots[p]), 24.0, 40.0, 0.3 if p == "d" and 20 <= f < 60 else 0.9))
            who[1, f, k] = p
    return rows, who


def blobs():
    rng = random.Random(9)
    return [(m, f, k, 2, rng.uniform(0, 90), rng.uniform(0, 60), rng.uniform(10, 30), rng.uniform(10, 40), rng.choice((0.05, 0.3, 0.45, 0.6, 0.9))) for m in (5, 6) for f in range(0, 60, 1 + m % 2) for k in range(rng.randint(0, 7))]


def found(df):
    return {(r.match_id, r.frame_seq, r.det_ord): r.track_no for r in df.collect()}


def test_planted_paths_keep_their_numbers(spark):
    rows, who = crossing()
    got = found(tracking.tracked(tracking.framed(spark.createDataFrame(rows, SCHEMA).repartition(3))))
    assert len({(who[k], no) for k, no in got.items()}) == 4 and set(got.values()) == {0, 1, 2, 3}
    assert got == plain(rows)


def test_any_boxes_against_the_plain_rules(spark):
    rows = blobs()
    got = found(tracking.tracked(tracking.framed(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain(rows) and None in got.values() and len(set(got.values())) > 20


def test_matches_over_many_small_batches(spark):
    rows = blobs() + crossing()[0]
    frames = tracking.framed(spark.createDataFrame(rows, SCHEMA)).unionByName(spark.createDataFrame([(7, 1, None), (7, 2, [])], f"match_id long, frame_seq long, dets {tracking.DETS}"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(size)
    spark.conf.set(size, 7)
    try:
        assert found(tracking.tracked(frames)) == plain(rows)
    finally:
        spark.conf.set(size, own)


def test_lost_tracks_end(spark):
    rows = [(1, f, 0, 2, 50.0, 50.0, 20.0, 20.0, 0.9) for f in (0, 1, 31, 62)]
    got = found(tracking.tracked(tracking.framed(spark.createDataFrame(rows, SCHEMA))))
    assert [got[1, f, 0] for f in (0, 1, 31, 62)] == [0, 0, 0, 1]
    assert tracking.tracked(tracking.framed(spark.createDataFrame([], SCHEMA))).collect() == []


def away():
    """Players on straight ways: one isn't seen for 50 frames, one comes back elsewhere, one only faintly, one first in frame 60."""
    rows = [(1, f, k, 2, x, y, 20.0, 20.0, sure) for f in (0, 1, 2, 53, 54, 60, 61) for k, x, y, sure in ((0, 50.0 + f, 50.0, 0.9), (1, 50.0 if f < 9 else 300.0, 150.0, 0.9), (2, 50.0, 250.0, 0.9 if f < 9 else 0.3), (3, 100.0, 350.0, 0.9)) if k != 3 or f > 54]
    return rows, {(m, f, k): {0: 0, 1: 1 if f < 9 else 3, 2: 2 if f < 9 else None, 3: 4}[k] for m, f, k, *_ in rows}


def test_lost_tracks_return_by_rule(spark):
    rows, expected = away()
    frames = tracking.framed(spark.createDataFrame(rows, SCHEMA))
    assert found(tracking.tracked(frames, tracking.Rules(returns=True))) == expected
    assert found(tracking.tracked(frames)) == plain(rows) != expected


REPEATED = 13  # every event so often, with the same keys: players are unseen or faint for more than Rules.buffer frames


def repeated(spark, sf_dir, tmp_path):
    one = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id < 6")
    one.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(REPEATED)))).drop("i").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def by_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    rows = con.sql(f"SELECT match_id, frame_seq, det_ord, track_no FROM ({flows.SQL[name]})").fetchall()
    return {r[:3]: r[3] for r in rows}


@pytest.mark.parametrize("name", ["tracked_lanes", "stream_tracked"])
def test_lanes_of_repeated_events_against_sql(spark, sf_dir, tmp_path, name):
    folder = repeated(spark, sf_dir, tmp_path)
    assert found(flows.QUERIES[name](spark, folder)) == by_sql(name, folder)


@pytest.mark.parametrize("cuts", [(7, 50), (1, 2)])
def test_stream_over_any_split(spark, cuts):
    rows = blobs() + crossing()[0]
    frames = tracking.framed(spark.createDataFrame(rows, SCHEMA))
    a, b = cuts
    parts = [F.col("frame_seq") < a, F.col("frame_seq").between(a, b), F.col("frame_seq") > b]
    assert found(stateful.run_to_end(tracking.tracked_stream(stateful.in_parts(frames, parts)))) == plain(rows)


def test_frames_that_come_too_late_have_no_tracks():
    import numpy as np

    t, box = tracking.Tracker(tracking.Rules()), np.array([[5.0, 5.0, 4.0, 4.0]])
    assert t.step(3, box, np.array([0.9])) == [0] and t.step(3, box, np.array([0.9])) == [None] and t.step(4, box, np.array([0.9])) == [0]

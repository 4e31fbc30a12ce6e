"""Small matches worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from matchlake.functions import geometry
from matchlake.operators import events as ev, frames as fr, spatial, stats
from matchlake.plans.profiles import ELEVEN, FIVE
from matchlake.sources.predictions import DETECTIONS


def detections(spark, p, frames):
    """frames: (ball or None, [(x, y, side)]) in metres, one for each frame; pixels are those of a 640 x 360 image."""
    rows = []
    for seq, (ball, players) in enumerate(frames):
        px = lambda x, y: (x / p.width * 640.0, y / p.height * 360.0)
        base = (1, seq, 5 * (seq + 1), 5.0 * seq)
        if ball:
            rows.append((*base, 0, 0, *px(*ball), 6.0, 6.0, 0.9, None, None))
        rows += [(*base, i + 1, 2, *px(x, y), 12.0, 30.0, 0.9, i, side) for i, (x, y, side) in enumerate(players)]
        if not ball and not players:
            rows.append((*base, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, DETECTIONS)


def owned(spark, p, frames):
    return fr.with_owner(fr.frame_table(detections(spark, p, frames), p, 640.0, 360.0), p)


def kinds(spark, p, frames):
    found = ev.events(fr.with_state(owned(spark, p, frames), p), p)
    return [(r.frame_seq, r.type, r.team_side) for r in found.orderBy("event_seq").collect()]


def test_xg_values(spark):
    row = spark.range(1).select(*[geometry.xg(F.lit(x), F.lit(12.5), F.lit(0.0), FIVE).alias(f"x{int(x)}") for x in (6.0, 21.0)]).first()
    assert 0.5 < row.x6 < 0.95
    assert row.x21 == pytest.approx(0.3274, abs=1e-4)  # what the formula gives at long range


def test_xg_is_a_probability(spark):
    grid = spark.range(14).select((F.col("id") * 3.0).alias("x")).crossJoin(spark.range(9).select((F.col("id") * 3.0).alias("y")))
    low, high = grid.select(geometry.xg(F.col("x"), F.col("y"), F.lit(42.0), FIVE).alias("v")).agg(F.min("v"), F.max("v")).first()
    assert 0 <= low <= high <= 1


@pytest.mark.parametrize("p,empty", [(FIVE, (0.0, 100.0)), (ELEVEN, (50.0, 50.0))])
def test_no_detections(spark, p, empty):
    frames = owned(spark, p, [(None, [])] * 3)
    row = fr.possession(frames, p).first()
    assert (row.home_pct, row.away_pct) == empty and row.none_frames == 3


def test_gap_in_ball_frames(spark):
    me = lambda x, y: [(x, y, "home")]
    frames = lambda far: [((20, 12), me(20, 12)), (None, me(20, 12)), ((20 + far, 12), me(20 + far, 12))]
    five, eleven = (stats.pass_stats(fr.with_state(owned(spark, p, frames(5)), p), p).first() for p in (FIVE, ELEVEN))
    assert five.home_completed == 0 and eleven.home_completed == 1


@pytest.mark.parametrize("p,reach", [(FIVE, 1.0), (ELEVEN, 3.0)])
def test_reach_is_exclusive(spark, p, reach):
    rows = owned(spark, p, [((0.0, 0.0), [(reach, 0.0, "home")]), ((0.0, 0.0), [(reach * 0.99, 0.0, "away")])]).orderBy("frame_seq").collect()
    assert [r.owner for r in rows] == [None, "away"]


def test_ties_and_order(spark):
    near = [(10.9, 10.0, "away"), (10.1, 10.0, "home")]
    assert owned(spark, FIVE, [((10, 10), near)]).first().owner == "away"
    assert owned(spark, ELEVEN, [((10, 10), near)]).first().owner == "home"
    same = [(11.0, 10.0, "away"), (9.0, 10.0, "home")]
    assert owned(spark, ELEVEN, [((10, 10), same)]).first().owner == "away"


def test_goal_is_a_shot_too(spark):
    frames = [((90, 34), [(90, 34, "home")]), ((104.5, 34), [(104.5, 34, "home")])]
    found = ev.events(fr.with_state(owned(spark, ELEVEN, frames), ELEVEN), ELEVEN)
    assert [r.type for r in found.orderBy("event_seq").collect()] == ["shot_on_target", "goal"]
    row = stats.event_stats(found).first()
    each = found.first().xg
    assert row.home_shots == 2 and row.home_goals == 1 and row.home_xg == pytest.approx(2 * each, abs=0.005)


def test_corner_islands(spark):
    corner, mid = (0.5, 0.5), (20.0, 12.0)
    by = lambda at, side: [(*at, side)]
    frames = [(corner, by(corner, "home")), (mid, by(mid, "home")), (mid, by(mid, "away")), (corner, by(corner, "away")), (corner, by(corner, "away")), (mid, by(mid, "home")), (corner, by(corner, "home"))]
    assert [k for k in kinds(spark, FIVE, frames) if k[1] == "corner"] == [(3, "corner", "away"), (6, "corner", "home")]


def test_corner_cooldown(spark):
    near, mid = (1.0, 1.0), (50.0, 34.0)
    frames = [(near if i in (1, 3, 8, 9, 15) else mid, [(*(near if i in (1, 3, 8, 9, 15) else mid), "home")]) for i in range(17)]
    assert [k[0] for k in kinds(spark, ELEVEN, frames) if k[1] == "corner"] == [1, 8, 15]


@pytest.mark.parametrize("p,empty", [(FIVE, 0.0), (ELEVEN, 100.0)])
def test_momentum_windows(spark, p, empty):
    found = spark.createDataFrame([(1, 120.0, "possession_change", "home"), (1, 240.0, "possession_change", "away")], "match_id long, ts_s double, type string, team_side string")
    length = spark.createDataFrame([(1, 480.0)], "match_id long, duration double")
    rows = {r.minute: (r.home, r.away) for r in stats.momentum(found, length, p).collect()}
    assert rows == {0: (0.0, empty), 2: (100.0, 0.0), 4: (50.0, 50.0), 6: (0.0, 100.0), 8: (0.0, empty)}


def zones(spark, points):
    return {r.track_id: r.area for r in spatial.voronoi(fr.frame_table(detections(spark, FIVE, [(None, [(x, y, "home") for x, y in points])]), FIVE, 640.0, 360.0), FIVE).collect()}


def test_voronoi(spark):
    assert zones(spark, [(10, 10), (20, 10), (10, 20), (20, 20), (15, 15)]) == {0: 0.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 50.0}
    assert zones(spark, [(10, 10), (20, 10), (10, 20)]) == {}
    assert set(zones(spark, [(5, 5), (10, 10), (15, 15), (20, 20)]).values()) == {0.0}


def density(spark, points, least=5):
    rows = [(1, 7, float(x), float(y)) for x, y in points]
    return spatial.heat_density(spark.createDataFrame(rows, "match_id long, track_id long, x double, y double"), FIVE, least).collect()


def test_density(spark):
    assert density(spark, [(1, 1), (2, 2)], 3) == []
    assert density(spark, [(i, 2 * i) for i in range(9)]) == []  # on a line
    assert density(spark, [(i % 10, i % 8) for i in range(4)]) == []
    found = density(spark, [(i % 10, i % 8) for i in range(30)])
    assert found and all(0.1 <= r.intensity <= 1 for r in found) and max(r.intensity for r in found) == 1


def test_network_caps(spark):
    people = [(5 + i * 0.3, 12.0, "home") for i in range(25)]
    points = spatial.positions(fr.frame_table(detections(spark, FIVE, [(None, people)] * 3), FIVE, 640.0, 360.0))
    nodes = spatial.nodes(points, FIVE)
    edges = spatial.edges(nodes, FIVE)
    assert nodes.count() == 25 and edges.count() == 40
    kept = nodes.filter(F.col("node_seq") <= FIVE.node_cap)
    assert spatial.resolved_edges(edges, kept).count() == edges.filter((F.col("from_id").cast("int") < 20) & (F.col("to_id").cast("int") < 20)).count() < 40


def test_rounding_is_half_up(spark):
    row = spark.range(1).select(geometry.jround(F.lit(0.125), 2).alias("a"), geometry.fixed(F.lit(0.125), 2).alias("b"), geometry.jround(F.lit(-0.5), 0).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.13, "0.13", 0.0)


def test_homography_without_a_solution(spark):
    h = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0)])
    x, y = geometry.homography(F.lit(1.0), F.lit(2.0), h)
    assert tuple(spark.range(1).select(x.alias("x"), y.alias("y")).first()) == (None, None)


def test_summary_invariants(spark, sf_dir):
    from matchlake.plans.queries import match_summary

    for r in match_summary(spark, sf_dir).collect():
        assert math.isclose(r.home_pct + r.away_pct, 100) and r.home_goals <= r.home_shots and r.away_goals <= r.away_shots
    doc = stats.nested(match_summary(spark, sf_dir)).first()
    assert doc.stats.possession.home == pytest.approx(100 - doc.stats.possession.away)


def test_event_cap(spark):
    rows = spark.createDataFrame([(m, i) for m in (1, 2) for i in range(1, 251 if m == 1 else 4)], "match_id long, event_seq long")
    kept = ev.capped(rows, "event_seq", ELEVEN.event_cap).groupBy("match_id").agg(F.count("*").alias("n"), F.max("event_seq").alias("last")).orderBy("match_id").collect()
    assert [tuple(r) for r in kept] == [(1, 200, 200), (2, 3, 3)]


def test_long_corner_runs(spark):
    """Against a walk over the frames, with runs that are longer than the gap."""
    near = [i for i in range(60) if i % 13 in (0, 1, 2, 3, 4, 7, 8, 11) or 20 < i < 34]
    at = lambda i: (1.0, 1.0) if i in near else (50.0, 34.0)
    frames = [(at(i), [(*at(i), "home")]) for i in range(60)]
    want, last = [], -10
    for i in near:
        if i - last > ELEVEN.corner_gap:
            want.append(i)
            last = i
    assert [k[0] for k in kinds(spark, ELEVEN, frames) if k[1] == "corner"] == want

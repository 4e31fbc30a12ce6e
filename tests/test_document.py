"""Documents of whole matches from rows of players, against frames that hold all their players."""

import pytest
from pyspark.sql import functions as F

from matchlake import scratch
from matchlake.operators import frames as fr, spatial
from matchlake.plans import queries
from matchlake.plans.profiles import ELEVEN
from matchlake.sources import fixtures as fx


@pytest.fixture(scope="module")
def document(spark, sf_dir):
    made = len(scratch._made)
    found = queries.whole_match(spark, sf_dir)
    return found, scratch._made[made:]


def listed(spark, sf_dir):
    return spatial.positions(fr.frame_table(fx.detections(spark, sf_dir), ELEVEN, fx.FRAME_W, fx.FRAME_H))


def test_players_are_numbered_as_in_their_list(spark, sf_dir):
    ours = spatial.numbered(spatial.player_points(fx.detections(spark, sf_dir), ELEVEN, fx.FRAME_W, fx.FRAME_H))
    theirs = listed(spark, sf_dir)
    assert sorted(map(repr, ours.select(*theirs.columns).collect())) == sorted(map(repr, theirs.collect()))


def test_players_that_are_not_sure_leave_no_gap(spark):
    """Places are those among the sure players of the frame; two frames, the second without its first player."""
    rows = [(1, f, d, 100 + d, side, 0.1 if (f, d) in ((0, 2), (1, 1)) else 0.9) for f in (0, 1) for d, side in ((1, "home"), (2, "away"), (3, "home"), (7, "away"))]
    seen = spark.createDataFrame(rows, "match_id long, frame_seq long, det_ord long, track_id long, team_side string, confidence double").selectExpr("*", "2L AS class_id", "det_ord * 1.0D AS x", "1.0D AS y")
    found = spatial.numbered(spatial.player_points(seen, ELEVEN, ELEVEN.width, ELEVEN.height)).orderBy("frame_seq", "det_ord").collect()
    assert [(r.frame_seq, r.det_ord, r.i) for r in found] == [(0, 1, 0), (0, 3, 1), (0, 7, 2), (1, 2, 0), (1, 3, 1), (1, 7, 2)]


def test_nodes_over_the_cap_share_a_place(spark):
    """14 of a side in 3 frames: places 0 and 11, 1 and 12, 2 and 13 are one player each, in the order of the first of them."""
    points = spark.range(3).select(F.lit(1).cast("long").alias("match_id"), F.col("id").alias("frame_seq"), F.posexplode(F.sequence(F.lit(1), F.lit(14))).alias("i", "d")).selectExpr(
        "match_id", "frame_seq", "CAST(d AS long) AS det_ord", "CAST(i AS long) AS i", "CAST(i AS double) AS x", "2.0D AS y", "'home' AS team", "CAST(i AS long) AS track_id"
    )
    found = [(r.node_seq, r.player_id, r.involvement, r.x) for r in spatial.nodes(points, ELEVEN).orderBy("node_seq").collect()]
    assert found == [(i + 1, f"home_{i}", 6 if i < 3 else 3, i + 5.5 if i < 3 else float(i)) for i in range(11)]


def test_heat_and_nodes_are_those_of_the_lists(spark, sf_dir, document):
    seen = listed(spark, sf_dir)
    heat = spatial.heat_histogram(seen, ELEVEN).selectExpr("match_id", "team", "floor(x * 1000 + 0.5) / 1000.0D AS x", "floor(y * 1000 + 0.5) / 1000.0D AS y", "intensity")
    ours = document[0].select("match_id", F.explode("heat").alias("h")).select("match_id", "h.team", "h.x", "h.y", "h.intensity")
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, heat.collect()))
    nodes = document[0].select("match_id", F.explode("nodes").alias("n")).select("match_id", "n.*")
    theirs = spatial.nodes(seen, ELEVEN).select(*nodes.columns)
    assert sorted(map(repr, nodes.collect())) == sorted(map(repr, theirs.collect()))
    assert all(r.heat == sorted(r.heat) for r in document[0].select("heat").collect())


def test_no_players_are_gathered_or_written(spark, document):
    """lists of all players were gathered (9 GB in memory spilled at 60 times), written and read again."""
    assert all("players" not in spark.read.parquet(path).columns for path in document[1])
    assert "players" not in document[0]._jdf.queryExecution().executedPlan().toString()


def test_nodes_need_no_sort_of_all_points(spark, sf_dir):
    """least pairs of frame and detection can't be held in a hash table, and had all points sorted."""
    plan = queries._nodes(spark, sf_dir, ELEVEN)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert [line for line in plan.splitlines() if "partial_count(1)" in line and "HashAggregate" in line]

"""Owned frames put together from near rows only, against the frames with all players."""

import pytest
from pyspark.sql import functions as F

from matchlake.functions import geometry
from matchlake.operators import frames as fr
from matchlake.plans import queries
from matchlake.plans.profiles import ELEVEN, FIVE
from matchlake.sources import fixtures as fx


@pytest.mark.parametrize("p", [FIVE, ELEVEN], ids=lambda p: p.name)
@pytest.mark.parametrize("halves", [False, True])
def test_same_as_with_all_players(spark, sf_dir, p, halves):
    team = geometry.half_team(F.col("x"), fx.FRAME_W) if halves else None
    ours = queries.owned(spark, sf_dir, p, team)
    theirs = fr.with_owner(fr.frame_table(fx.detections(spark, sf_dir), p, fx.FRAME_W, fx.FRAME_H, team), p).drop("players")
    assert ours.schema.simpleString() == theirs.schema.simpleString()
    assert sorted(map(repr, ours.collect())) == sorted(map(repr, theirs.collect()))


def test_frames_without_ball_or_player_stay(spark):
    ball = "struct<det_ord: bigint, x: double, y: double, confidence: double>"
    rows = [  # a frame without a ball, one whose ball isn't sure, one with no player near, one with two
        (1, 0, 5, 0.0, 0, None, None, None, None, None, None, True), (1, 0, 5, 0.0, 1, 2, 10.0, 10.0, 0.9, "home", None, False),
        (1, 1, 10, 5.0, 0, 0, 10.0, 10.0, 0.1, None, (0, 10.0, 10.0, 0.1), True), (1, 1, 10, 5.0, 1, 2, 10.0, 10.0, 0.9, "home", (0, 10.0, 10.0, 0.1), False),
        (1, 2, 15, 10.0, 0, 0, 10.0, 10.0, 0.9, None, (0, 10.0, 10.0, 0.9), True), (1, 2, 15, 10.0, 1, 2, 90.0, 60.0, 0.9, "home", (0, 10.0, 10.0, 0.9), False),
        (1, 3, 20, 15.0, 0, 0, 10.0, 10.0, 0.9, None, (0, 10.0, 10.0, 0.9), True), (1, 3, 20, 15.0, 1, 2, 11.0, 10.0, 0.9, "home", (0, 10.0, 10.0, 0.9), False), (1, 3, 20, 15.0, 2, 2, 10.5, 10.0, 0.9, "away", (0, 10.0, 10.0, 0.9), False),
    ]
    schema = f"match_id long, frame_seq long, frame_idx long, ts_s double, det_ord long, class_id long, x double, y double, confidence double, team_side string, frame_ball {ball}, leads boolean"
    found = fr.owned_frames(spark.createDataFrame(rows, schema), ELEVEN, ELEVEN.width, ELEVEN.height).orderBy("frame_seq").collect()
    assert [(r.frame_seq, r.ball is not None, r.owner) for r in found] == [(0, False, None), (1, False, None), (2, True, None), (3, True, "away")]


def test_no_lists_of_players_are_gathered(spark, sf_dir):
    """gathered lists fell back to sorting all detections, 10 GB of which were spilled at 60 times."""
    plan = queries.owned(spark, sf_dir, ELEVEN)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan

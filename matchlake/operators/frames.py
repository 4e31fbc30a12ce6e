"""From detections to frames with a ball, players, an owner and the state before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import distance, jround, to_pitch
from matchlake.plans.profiles import Profile

BALL, PLAYERS = (0,), (1, 2)


def frame_table(detections: DataFrame, p: Profile, frame_w: float, frame_h: float, team: Column | None = None) -> DataFrame:
    """(match_id, frame_seq, frame_idx, ts_s, ball, players): one row for each frame, in pitch coordinates.

    The ball is the first ball detection in order. team gives the side of a player detection (team_side by default;
    half_team for sides by image half). Detections are hashed by match once; the grouping by frame and all later
    windows of a match find them in place. A frame without detections is a row with a null det_ord.
    """
    x, y = to_pitch(F.col("x"), frame_w, p.width), to_pitch(F.col("y"), frame_h, p.height)
    sure = lambda least: F.lit(True) if least is None else F.col("confidence") > least
    ball = F.min(F.when(F.col("class_id").isin(*BALL) & sure(p.ball_confidence), F.struct("det_ord", x.alias("x"), y.alias("y"))))
    player = F.struct("det_ord", x.alias("x"), y.alias("y"), (F.col("team_side") if team is None else team).alias("team"), "track_id")
    players = F.array_sort(F.collect_list(F.when(F.col("class_id").isin(*PLAYERS) & sure(p.player_confidence), player)))
    kept = detections.repartition(F.col("match_id"))
    return kept.groupBy("match_id", "frame_seq").agg(F.min("frame_idx").alias("frame_idx"), F.min("ts_s").alias("ts_s"), ball.alias("ball"), players.alias("players"))


def with_owner(frames: DataFrame, p: Profile) -> DataFrame:
    """Adds owner: the side of the nearest player, or of the first in order, within reach of the ball; null if none.

    Players stand in their frame's row, so this is no join.
    """
    gap = lambda s: distance(F.col("ball.x"), F.col("ball.y"), s["x"], s["y"])
    if p.owner_rule == "nearest":
        ranked = F.transform("players", lambda s: F.struct(gap(s).alias("d"), s["det_ord"].alias("o"), s["team"].alias("team")))
    else:
        ranked = F.transform("players", lambda s: F.struct(s["det_ord"].alias("o"), gap(s).alias("d"), s["team"].alias("team")))
    best = F.array_min(F.filter(ranked, lambda s: s["d"] < p.reach))
    return frames.withColumn("owner", F.when(F.col("ball").isNotNull(), best["team"]))


BEST = {"nearest": "array<struct<gap: double, det_ord: bigint, team: string>>", "first": "array<struct<det_ord: bigint, gap: double, team: string>>"}


def owned_frames(detections: DataFrame, p: Profile, frame_w: float, frame_h: float, team: Column | None = None) -> DataFrame:
    """The rows of with_owner(frame_table()) without their players, from detections that have their frame's ball beside them.

    detections(…, frame_ball, leads): frame_ball(det_ord, x, y, confidence) is the frame's one ball or null, leads is true in one
    row of each frame. Players out of reach can't own the ball and go no further, so that a frame is put together from the row
    that leads it and the few near ones; no list of players is made, sorted or spilled.
    """
    sure = lambda least, c: F.lit(True) if least is None else c > least
    x, y = to_pitch(F.col("x"), frame_w, p.width), to_pitch(F.col("y"), frame_h, p.height)
    at = F.struct(F.col("frame_ball.det_ord").alias("det_ord"), to_pitch(F.col("frame_ball.x"), frame_w, p.width).alias("x"), to_pitch(F.col("frame_ball.y"), frame_h, p.height).alias("y"))
    seen = detections.withColumn("ball", F.when(F.col("frame_ball").isNotNull() & sure(p.ball_confidence, F.col("frame_ball.confidence")), at))
    seen = seen.withColumn("gap", distance(F.col("ball.x"), F.col("ball.y"), x, y))
    near = F.coalesce(F.col("class_id").isin(*PLAYERS) & sure(p.player_confidence, F.col("confidence")) & (F.col("gap") < p.reach), F.lit(False))
    first = ("gap", "det_ord") if p.owner_rule == "nearest" else ("det_ord", "gap")
    mine = F.when(near, F.struct(*first, (F.col("team_side") if team is None else team).alias("team")))
    # explode and no filter: Spark would push that down and put the whole expressions of x and y into it, many times over
    kept = seen.repartition(F.col("match_id")).select("match_id", "frame_seq", "frame_idx", "ts_s", "ball", F.explode(F.when(F.col("leads") | near, F.array(mine)).otherwise(F.array().cast(BEST[p.owner_rule]))).alias("best"))
    found = kept.groupBy("match_id", "frame_seq").agg(F.min("frame_idx").alias("frame_idx"), F.min("ts_s").alias("ts_s"), F.min("ball").alias("ball"), F.min("best").alias("best"))
    return found.withColumn("owner", F.col("best.team")).drop("best")


def with_state(owned: DataFrame, p: Profile) -> DataFrame:
    """Adds the owner and the ball of the frame before, and the ball's step since then, under the profile's rule.

    The frame before is the one before in the match, or the last one with a ball. All frames stay.
    """
    order = Window.partitionBy("match_id").orderBy("frame_seq")
    now = F.struct("owner", "ball")
    if p.state_over_ball_frames:
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        before = F.last(F.when(F.col("ball").isNotNull(), now), ignorenulls=True).over(earlier)
    else:
        before = F.lag(now).over(order)
    out = owned.withColumn("before", before).withColumn("prev_owner", F.col("before.owner")).withColumn("prev_ball", F.col("before.ball")).drop("before")
    return out.withColumn("step", distance(F.col("ball.x"), F.col("ball.y"), F.col("prev_ball.x"), F.col("prev_ball.y")))


def shares(counts: DataFrame, p: Profile) -> DataFrame:
    """Adds the shares of owned frames to counts with home_frames and away_frames."""
    total = F.col("home_frames") + F.col("away_frames")
    home = F.when(total > 0, jround(F.col("home_frames") / F.greatest(total, F.lit(1)) * 100, 1)).otherwise(p.empty_possession)
    return counts.withColumn("home_pct", home).withColumn("away_pct", jround(100 - F.col("home_pct"), 1))


def possession(owned: DataFrame, p: Profile) -> DataFrame:
    """Frames owned by each side and by none, and the shares of owned frames."""
    n = owned.groupBy("match_id").agg(*[F.count_if(F.coalesce("owner", F.lit("none")) == side).alias(f"{side}_frames") for side in ("home", "away", "none")], F.count(F.lit(1)).alias("frames"))
    return shares(n, p)


def half_possession(detections: DataFrame, frame_w: float) -> DataFrame:
    """Whole-number shares of ball detections in each half of the image."""
    n = detections.filter(F.col("class_id").isin(*BALL)).groupBy("match_id").agg(F.count_if(F.col("x") < frame_w / 2).alias("home_balls"), F.count(F.lit(1)).alias("balls"))
    pct = F.floor(F.col("home_balls") / F.greatest("balls", F.lit(1)) * 100 + F.lit(0.5)).cast("long")
    return n.withColumn("home_pct", pct).withColumn("away_pct", 100 - F.col("home_pct"))


def ball_frames(detections: DataFrame) -> DataFrame:
    """Frames with a ball, of all frames, for each match."""
    frames = detections.groupBy("match_id", "frame_seq").agg(F.bool_or(F.col("class_id").isin(*BALL)).alias("ball"))
    return frames.groupBy("match_id").agg(F.count_if("ball").alias("ball_frames"), F.count(F.lit(1)).alias("frames"))

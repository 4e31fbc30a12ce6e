"""Event detection: one pass over the frames of a match gives all events in the order of their emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.geometry import distance, fixed, goal_x, jround, near_corner, xg
from matchlake.plans.profiles import Profile


def _event(rank: int, kind: Column | str, side: Column, when: Column, xg_: Column | None = None, description: Column | None = None) -> Column:
    none, at = F.lit(None).cast("double"), xg_ is not None
    made = F.struct(
        F.lit(rank).alias("rank"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), side.alias("team_side"), (xg_ if at else none).alias("xg"),
        (F.col("ball.x") if at else none).alias("x"), (F.col("ball.y") if at else none).alias("y"), (F.lit(None).cast("string") if description is None else description).alias("description"),
    )
    return F.when(when, made)


def changed() -> Column:
    """Whether possession changes in a frame with its state: both frames are owned, by different sides."""
    return F.col("owner") != F.col("prev_owner")


def detected(state: DataFrame, p: Profile) -> DataFrame:
    """Adds found, the events of each frame but for corners, and near, whether the ball is near a corner."""
    x, y, owner = F.col("ball.x"), F.col("ball.y"), F.col("owner")
    other = F.when(owner == "home", "away").otherwise("home")
    state = state.withColumn("goal_gap", distance(x, y, goal_x(owner, p), F.lit(p.height / 2))).withColumn("chance", xg(x, y, goal_x(owner, p), p))
    gap, chance = F.col("goal_gap"), F.col("chance")
    shot = owner.isNotNull() & (F.col("step") > p.shot_step) & (gap < p.shot_distance)
    found = [_event(1, "possession_change", owner, changed())]
    if p.fouls:
        found.append(_event(2, "foul", other, changed() & (x > 30) & (x < 75) & (F.col("step") < 2)))
    kind = F.when((gap < p.target_distance) & (chance > p.target_xg), "shot_on_target").otherwise("shot")
    worth = jround(chance, p.xg_digits)
    found.append(_event(3, kind, owner, shot, worth))
    found.append(_event(4, "goal", owner, shot & (gap < p.goal_distance), worth, F.concat(F.lit(p.goal_text), fixed(chance, 2))))
    near = near_corner(x, y, p) & F.col("ball").isNotNull()
    return state.withColumn("found", F.filter(F.array(*found), lambda e: e.isNotNull())).withColumn("near", F.coalesce(near, F.lit(False)))


TAKEN = "array<struct<frame_seq: bigint, ts_s: double, owner: string>>"


def corner_islands(frames: DataFrame) -> DataFrame:
    """Adds taken: the frame itself, if it is the first near frame after a run of other events; empty before the first event of a match."""
    upto = Window.partitionBy("match_id").orderBy("frame_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = frames.withColumn("others", F.sum(F.size("found")).over(upto))
    island = Window.partitionBy("match_id", "others").orderBy("frame_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.struct("frame_seq", "ts_s", F.coalesce("owner", F.lit("home")).alias("owner"))
    first = F.col("near") & (F.col("others") > 0) & (F.count_if("near").over(island) == 1)
    return marked.withColumn("taken", F.when(first, F.array(here)).otherwise(F.array()).cast(TAKEN))


def corner_cooldown(frames: DataFrame, gap: int) -> DataFrame:
    """Adds taken: the owned near frames that are more than gap frames after the last one taken.

    A near frame that is that far from the near frame before it is taken whatever came earlier. So near frames are dealt
    to runs that begin with such a frame, and only the frames of one run are walked through, in the row that begins it:
    no match has to fit into a row, and the frames are read once.
    """
    order = Window.partitionBy("match_id").orderBy("frame_seq")
    spot = F.when(F.col("near") & F.col("owner").isNotNull(), F.struct("frame_seq", "ts_s", "owner"))
    out = frames.withColumn("spot", spot).withColumn("earlier", F.last("spot.frame_seq", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("begins", F.col("spot").isNotNull() & F.coalesce(F.col("frame_seq") - F.col("earlier") > gap, F.lit(True)))
    out = out.withColumn("run", F.count_if("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("spots", F.collect_list("spot").over(Window.partitionBy("match_id", "run")))
    far = lambda acc, s: s["frame_seq"] - F.get(acc, F.size(acc) - 1)["frame_seq"] > gap
    walked = F.aggregate(F.array_sort("spots"), F.array().cast(TAKEN), lambda acc, s: F.when((F.size(acc) == 0) | far(acc, s), F.array_append(acc, s)).otherwise(acc))
    return out.withColumn("taken", F.when(F.col("begins"), walked).otherwise(F.array().cast(TAKEN))).drop("spot", "earlier", "begins", "run", "spots")


def with_corners(state: DataFrame, p: Profile) -> DataFrame:
    """Frames with found, their events, and taken, the corners told in their row; each corner of a match is told once."""
    frames = detected(state, p)
    return corner_islands(frames) if p.corner_rule == "islands" else corner_cooldown(frames, p.corner_gap)


def events(state: DataFrame, p: Profile) -> DataFrame:
    """(match_id, event_seq, frame_seq, ts_s, type, team_side, xg, x, y, description), in the order of emission from 1 on."""
    return told(with_corners(state, p))


def told(frames: DataFrame) -> DataFrame:
    """The rows of events() from frames with found and taken."""
    names = ("rank", "type", "team_side", "xg", "x", "y", "description")
    own = F.transform("found", lambda e: F.struct(F.col("frame_seq").alias("frame_seq"), F.col("ts_s").alias("ts_s"), *[e[n].alias(n) for n in names]))
    none = F.lit(None).cast("double")
    corner = F.transform("taken", lambda c: F.struct(
        c["frame_seq"].alias("frame_seq"), c["ts_s"].alias("ts_s"), F.lit(5).alias("rank"), F.lit("corner").alias("type"), c["owner"].alias("team_side"), none.alias("xg"), none.alias("x"), none.alias("y"), F.lit(None).cast("string").alias("description"),
    ))
    rows = frames.select("match_id", F.explode(F.concat(own, corner)).alias("e")).select("match_id", "e.*")
    seq = F.row_number().over(Window.partitionBy("match_id").orderBy("frame_seq", "rank")).cast("long")
    return rows.withColumn("event_seq", seq).drop("rank")


def capped(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The first `most` rows of each match; Spark stops each match's sort there."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy("match_id").orderBy(order))).filter(F.col("at") <= most).drop("at")

"""Statistics of a match from its frames and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.geometry import jround
from matchlake.operators.events import with_corners
from matchlake.operators.frames import shares
from matchlake.plans.profiles import Profile

SHOTS = ("shot", "shot_on_target", "goal")


def _of(side: str):
    return lambda e: e["team_side"] == side


def _owned(side: str):
    return lambda c: c["owner"] == side


def pass_rates(out: DataFrame, p: Profile) -> DataFrame:
    """Adds total passes and accuracy of each side; the total has a floor that follows possession."""
    for side in ("home", "away"):
        total = F.greatest(F.col(f"{side}_completed"), F.floor(F.col(f"{side}_pct") * F.lit(p.pass_floor) + F.lit(0.5)).cast("long"))
        out = out.withColumn(f"{side}_total", total)
        out = out.withColumn(f"{side}_accuracy", F.when(F.col(f"{side}_total") > 0, jround(F.col(f"{side}_completed") / F.greatest(f"{side}_total", F.lit(1)) * 100, 1)).otherwise(0.0))
    return out


def pass_stats(state: DataFrame, p: Profile) -> DataFrame:
    """Completed and total passes and accuracy of each side."""
    passed = (F.col("owner") == F.col("prev_owner")) & (F.col("step") > p.pass_step)
    counts = [F.count_if(passed & (F.col("owner") == side)).alias(f"{side}_completed") for side in ("home", "away")]
    owned = [F.count_if(F.col("owner") == side).alias(f"{side}_frames") for side in ("home", "away")]
    out = pass_rates(shares(state.groupBy("match_id").agg(*counts, *owned), p), p)
    return out.select("match_id", *[f"{side}_{n}" for side in ("home", "away") for n in ("completed", "total", "accuracy")])


def event_stats(events: DataFrame) -> DataFrame:
    """Shots (goals are counted among them), shots on target, xG, goals, fouls and corners of each side."""
    kind, out = F.col("type"), []
    for side in ("home", "away"):
        own = F.col("team_side") == side
        count = lambda c, own=own: F.count_if(own & c)
        out += [
            count(kind.isin(*SHOTS)).alias(f"{side}_shots"), count(kind == "shot_on_target").alias(f"{side}_on_target"),
            jround(jround(F.sum(F.when(own & kind.isin(*SHOTS), F.coalesce("xg", F.lit(0.0))).otherwise(0.0)), 6), 2).alias(f"{side}_xg"),
            count(kind == "goal").alias(f"{side}_goals"), count(kind == "foul").alias(f"{side}_fouls"), count(kind == "corner").alias(f"{side}_corners"),
        ]
    return events.groupBy("match_id").agg(*out)


def pressure(share: DataFrame) -> DataFrame:
    return share.select("match_id", *[jround(F.col(f"{side}_pct") / 20, 1).alias(f"{side}_pressure") for side in ("home", "away")])


def summary(state: DataFrame, p: Profile, goals: bool = False) -> DataFrame:
    """One flat row for each match, in one pass: events stay in their frames, so that all is one aggregation by match.

    goals adds first_ts, first_side, first_xg, last_ts and last_side of the match's goals, null where there are none.
    """
    return summary_of(with_corners(state, p), p, goals)


def summary_of(frames: DataFrame, p: Profile, goals: bool = False) -> DataFrame:
    """The rows of summary() from frames with found and taken."""
    owner, sides = F.col("owner"), ("home", "away")
    passed = (owner == F.col("prev_owner")) & (F.col("step") > p.pass_step)
    out = [F.count_if(F.coalesce("owner", F.lit("none")) == side).alias(f"{side}_frames") for side in (*sides, "none")] + [F.count(F.lit(1)).alias("frames")]
    for side in sides:
        own = F.filter("found", _of(side))
        many = lambda *kinds, own=own: F.sum(F.size(F.filter(own, lambda e: e["type"].isin(*kinds)))).cast("long")
        worth = F.aggregate(F.filter(own, lambda e: e["type"].isin(*SHOTS)), F.lit(0.0), lambda total, e: total + F.coalesce(e["xg"], F.lit(0.0)))
        out += [
            F.count_if(passed & (owner == side)).alias(f"{side}_completed"), many(*SHOTS).alias(f"{side}_shots"), many("shot_on_target").alias(f"{side}_on_target"),
            jround(jround(F.sum(worth), 6), 2).alias(f"{side}_xg"), many("goal").alias(f"{side}_goals"), many("foul").alias(f"{side}_fouls"),
            F.sum(F.size(F.filter("taken", _owned(side)))).cast("long").alias(f"{side}_corners"),
        ]
    if goals:
        goal = F.get(F.filter("found", lambda e: e["type"] == "goal"), F.lit(0))
        frames = frames.withColumn("goal", F.when(goal.isNotNull(), F.struct("frame_seq", "ts_s", goal["team_side"].alias("side"), goal["xg"].alias("xg"))))
        out += [F.min("goal").alias("first_goal"), F.max("goal").alias("last_goal")]
    flat = frames.groupBy("match_id").agg(*out)
    if goals:
        told = {f"{at}_{n}": F.col(f"{at}_goal.{c}") for at in ("first", "last") for n, c in (("ts", "ts_s"), ("side", "side"), ("xg", "xg")) if (at, n) != ("last", "xg")}
        flat = flat.withColumns(told).drop("first_goal", "last_goal")
    flat = pass_rates(shares(flat, p), p)
    return flat.withColumns({f"{side}_pressure": jround(F.col(f"{side}_pct") / 20, 1) for side in sides})


def nested(flat: DataFrame) -> DataFrame:
    """The summary as one document for each match."""
    side = lambda *names: F.struct(*[F.struct(*[F.col(f"{s}_{n}").alias(n) for n in names]).alias(s) for s in ("home", "away")])
    pair = lambda n: F.struct(*[F.col(f"{s}_{n}").alias(s) for s in ("home", "away")])
    return flat.select(
        "match_id",
        F.struct(
            pair("goals").alias("score"), pair("pct").alias("possession"), side("completed", "total", "accuracy").alias("passes"), side("shots", "on_target", "xg").alias("shots"),
            pair("fouls").alias("fouls"), pair("corners").alias("corners"), pair("pressure").alias("pressure_index"),
        ).alias("stats"),
    )


def composed(flat: DataFrame, **parts: tuple[DataFrame, str]) -> DataFrame:
    """One document for each match: its statistics, and for each part (rows, order) the match's rows as an array in that order.

    Parts are capped or bounded by a match's length before they come here; a match without rows of a part has an empty array.
    """
    out = nested(flat)
    for name, (rows, order) in parts.items():
        rest = [c for c in rows.columns if c not in ("match_id", order)]
        own = rows.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))
        out = out.join(own, "match_id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def momentum_minutes(duration: Column, p: Profile) -> Column:
    """Minutes 0, 2, 4 ... of a match."""
    minutes = F.ceil(duration / 60) if p.momentum_ceil else F.floor(duration / 60)
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(p.momentum_least).cast("long"), minutes.cast("long")), F.lit(2).cast("long"))


def momentum(events: DataFrame, durations: DataFrame, p: Profile) -> DataFrame:
    """(match_id, minute, home, away): shares of possession changes in the two minutes up to each even minute.

    Windows are closed at both ends: an event belongs to the next even minute, and one on a boundary to the window
    that begins there as well. Each event is sent to its one or two windows, so that no range join is needed.
    """
    first = (F.ceil(F.col("ts_s") / 120) * 2).cast("long")
    both = F.when(F.col("ts_s") % 120 == 0, F.array(first, first + 2)).otherwise(F.array(first))
    counts = events.filter("type = 'possession_change'").select("match_id", "team_side", F.explode(both).alias("minute")).groupBy("match_id", "minute").agg(F.count_if(F.col("team_side") == "home").alias("n_home"), F.count(F.lit(1)).alias("n"))
    return momentum_shares(counts, durations, p)


def momentum_shares(counts: DataFrame, durations: DataFrame, p: Profile) -> DataFrame:
    """(match_id, minute, home, away) of all minutes of a match from counts(match_id, minute, n_home, n) of those with changes."""
    grid = durations.select("match_id", F.explode(momentum_minutes(F.col("duration"), p)).alias("minute"))
    share = lambda n, empty: F.when(F.coalesce("n", F.lit(0)) > 0, jround(n / F.greatest(F.col("n"), F.lit(1)) * 100, 1)).otherwise(empty)
    return grid.join(counts, ["match_id", "minute"], "left").select("match_id", "minute", share(F.col("n_home"), 0.0).alias("home"), share(F.col("n") - F.col("n_home"), p.empty_momentum_away).alias("away"))


def first_last_goal(events: DataFrame) -> DataFrame:
    pick = lambda f, c: f(c, "event_seq")
    return events.filter("type = 'goal'").groupBy("match_id").agg(
        pick(F.min_by, "ts_s").alias("first_ts"), pick(F.min_by, "team_side").alias("first_side"), pick(F.min_by, "xg").alias("first_xg"), pick(F.max_by, "ts_s").alias("last_ts"), pick(F.max_by, "team_side").alias("last_side"), F.count(F.lit(1)).alias("goals")
    )

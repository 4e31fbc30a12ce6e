"""Sources of detections: prediction bodies, container metadata, frame samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREDICTIONS = "predictions array<struct<x: double, y: double, width: double, height: double, `class`: string, class_id: bigint, confidence: double>>"
PROBE = "streams array<struct<codec_type: string, r_frame_rate: string, duration: string, width: bigint, height: bigint>>"
DETECTIONS = "match_id BIGINT, frame_seq BIGINT, frame_idx BIGINT, ts_s DOUBLE, det_ord BIGINT, class_id BIGINT, x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, confidence DOUBLE, track_id BIGINT, team_side STRING"


def exploded(bodies: DataFrame) -> DataFrame:
    """Bodies(…, body) with a row for each prediction; a frame without any, or a broken body, keeps one row of nulls."""
    found = F.coalesce(F.from_json("body", PREDICTIONS)["predictions"], F.expr("cast(array() AS array<struct<x: double, y: double, width: double, height: double, class: string, class_id: bigint, confidence: double>>)"))
    rest = [c for c in bodies.columns if c != "body"]
    return bodies.select(*rest, F.posexplode_outer(found).alias("det_ord", "d")).select(*rest, F.col("det_ord").cast("long").alias("det_ord"), "d.class_id", "d.x", "d.y", "d.width", "d.height", "d.confidence")


def box_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def probed(bodies: DataFrame) -> DataFrame:
    """Bodies(…, body) of the container probe with fps, duration and size of the video stream; 30 fps and 1920x1080 where unknown."""
    video = F.filter(F.from_json("body", PROBE)["streams"], lambda s: s["codec_type"] == "video")
    v = F.get(video, F.lit(0))
    rate = F.split(F.coalesce(v["r_frame_rate"], F.lit("30/1")), "/")
    fps = F.coalesce(F.try_divide(F.get(rate, F.lit(0)).cast("double"), F.get(rate, F.lit(1)).cast("double")), F.lit(30.0))
    rest = [c for c in bodies.columns if c != "body"]
    return bodies.select(*rest, fps.alias("fps"), F.coalesce(v["duration"].cast("double"), F.lit(0.0)).alias("duration"), F.coalesce(v["width"], F.lit(1920)).alias("width"), F.coalesce(v["height"], F.lit(1080)).alias("height"))


def every_nth(frames: DataFrame, n: int = 5) -> DataFrame:
    return frames.filter(F.col("frame_idx") % n == 0)


def first_by_time(frames: DataFrame, step_s: float = 5.0, most: int = 60) -> DataFrame:
    """A frame every step_s seconds, at most `most` of a match."""
    return frames.filter((F.col("ts_s") % step_s == 0) & (F.col("frame_seq") < most))


def even_seeks(durations: DataFrame, n: int = 6) -> DataFrame:
    """n times spread evenly inside each match(…, duration)."""
    return durations.select("match_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"), "duration").select("match_id", F.col("i").cast("long").alias("i"), (F.col("duration") / (n + 1) * F.col("i")).alias("ts_s"))


def likely_durations(durations: DataFrame, otherwise: float = 300.0) -> DataFrame:
    """durations(match_id, duration) with a fixed one where it is missing, not positive or not finite."""
    d = F.col("duration")
    return durations.withColumn("duration", F.when((d > 0) & ~F.isnan(d) & (d < float("inf")), d).otherwise(otherwise))


def seeks_within(seeks: DataFrame, each_s: float = 3.0, total_s: float = 20.0) -> DataFrame:
    """The seeks(match_id, i, ts_s, took_s) that give a frame: found in under each_s, and before total_s have passed in all.

    A seek that takes longer is given up after each_s, which count as passed. A null time is one that never ends.
    """
    waited = F.least(F.coalesce("took_s", F.lit(each_s)), F.lit(each_s))
    passed = F.sum(waited).over(Window.partitionBy("match_id").orderBy("i"))
    return seeks.withColumn("passed_s", passed).filter((F.col("took_s") < each_s) & (F.col("passed_s") < total_s))

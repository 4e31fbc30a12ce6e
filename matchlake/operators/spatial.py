"""Heatmaps, Voronoi areas and pass networks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.cells import areas
from matchlake.functions.geometry import distance, inside, jround, to_pitch
from matchlake.plans.profiles import Profile

#: Cells of the histogram, and points of the density grid, across and down.
CELLS, POINTS = (21, 13), (21, 12)
BANDWIDTH = 0.3
#: Points whose kernels are worked out at a time, and tracks whose sums a task holds.
BLOCK, HELD = 2048, 4096


def positions(frames: DataFrame) -> DataFrame:
    """(match_id, frame_seq, det_ord, i, x, y, team, track_id) of players; i is the index in the frame's player list."""
    return frames.select("match_id", "frame_seq", F.posexplode("players").alias("i", "s")).select("match_id", "frame_seq", "s.det_ord", F.col("i").cast("long").alias("i"), "s.x", "s.y", "s.team", "s.track_id")


def heat_histogram(points: DataFrame, p: Profile) -> DataFrame:
    """Share of the fullest cell for each side and cell, where it is over a twentieth; sides with under 3 points have none."""
    nx, ny = CELLS
    cell = lambda v, size, n: F.least(F.lit(n - 1), F.floor(v / F.lit(size) * n)).cast("long")
    counts = points.groupBy("match_id", "team", cell(F.col("x"), p.width, nx).alias("cx"), cell(F.col("y"), p.height, ny).alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    side = Window.partitionBy("match_id", "team")
    share = counts.withColumn("most", F.max("n").over(side)).withColumn("all", F.sum("n").over(side)).filter("all >= 3").withColumn("share", F.col("n") / F.greatest(F.lit(1), F.col("most")))
    return share.filter("share > 0.05").select("match_id", "team", (F.col("cx") / nx * F.lit(p.width)).alias("x"), (F.col("cy") / ny * F.lit(p.height)).alias("y"), jround(F.col("share"), 3).alias("intensity"))


def player_points(detections: DataFrame, p: Profile, frame_w: float, frame_h: float) -> DataFrame:
    """(match_id, frame_seq, det_ord, track_id, team, x, y) of player detections in pitch coordinates, straight from the scan."""
    sure = F.lit(True) if p.player_confidence is None else F.col("confidence") > p.player_confidence
    return detections.filter(F.col("class_id").isin(1, 2) & sure).select("match_id", "frame_seq", "det_ord", "track_id", F.col("team_side").alias("team"), to_pitch(F.col("x"), frame_w, p.width).alias("x"), to_pitch(F.col("y"), frame_h, p.height).alias("y"))


def numbered(points: DataFrame) -> DataFrame:
    """Adds i, the place of each point among those of its frame in order of detection.

    As positions(frame_table()) has it, but rows stay rows: no list of a frame's players is made.
    """
    return points.withColumn("i", F.row_number().over(Window.partitionBy("match_id", "frame_seq").orderBy("det_ord")).cast("long") - 1)


def heat_density(points: DataFrame, p: Profile, least: int = 5) -> DataFrame:
    """Gaussian kernel density of each track on the grid, as a share of its largest value, where that is over a tenth.

    Tracks of under `least` points, or whose points lie on a line, have none. The kernel has the points' covariance
    times the squared bandwidth, written out. Tasks add up the kernels of a track as one array of all grid values,
    which are then added by their elements: what is shuffled follows the tracks, not the points or the grid.
    """
    place = ["match_id", "track_id"]
    spread = points.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"))
    b = BANDWIDTH * BANDWIDTH
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    spread = spread.filter(F.col("n") >= max(3, least)).withColumn("det", det).filter("det > 1e-9 * greatest(vx * vy, 1e-12)").drop("n")
    nx, ny = POINTS
    grid_x, grid_y = (np.arange(nx * ny) % nx) * p.width / (nx - 1), (np.arange(nx * ny) // nx) * p.height / (ny - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def taken() -> pa.RecordBatch:
            keys, values = list(held), np.concatenate(list(held.values()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, nx * ny), pa.int32()), pa.array(values))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [lists], names=[*place, "v"])

        for batch in batches:
            match, track, *numbers = (c.to_numpy() for c in batch.columns)
            for low in range(0, len(match), BLOCK):
                by = np.lexsort((track[low : low + BLOCK], match[low : low + BLOCK])) + low
                x, y, vx, vy, cxy, d = (v[by][:, None] for v in numbers)
                dx, dy = grid_x - x, grid_y - y
                kernels = np.exp(-((vy * dx * dx - 2 * cxy * dx * dy + vx * dy * dy) / (d * b)) / 2)
                m, t = match[by], track[by]
                first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (t[1:] != t[:-1])]))
                for key, total in zip(zip(m[first].tolist(), t[first].tolist()), np.add.reduceat(kernels, first, axis=0)):
                    held[key] = held[key] + total if key in held else total
                if len(held) > HELD:
                    yield taken()
        if held:
            yield taken()

    parts = points.join(spread, place).select(*place, "x", "y", "vx", "vy", "cxy", "det").mapInArrow(work, "match_id long, track_id long, v array<double>")
    zero = F.array_repeat(F.lit(0.0), nx * ny)
    dense = parts.groupBy(*place).agg(F.collect_list("v").alias("vs")).select(*place, F.aggregate("vs", zero, lambda total, v: F.zip_with(total, v, lambda c, w: c + w)).alias("v"))
    shares = dense.withColumn("most", F.array_max("v")).select(*place, F.posexplode(F.transform("v", lambda x: F.try_divide(x, F.col("most")))).alias("g", "share"))
    gx, gy = (F.col("g") % nx) * F.lit(p.width) / (nx - 1), F.floor(F.col("g") / nx) * F.lit(p.height) / (ny - 1)
    return shares.filter("share > 0.1").select(*place, jround(gx, 3).alias("x"), jround(gy, 3).alias("y"), jround(F.col("share"), 3).alias("intensity"))


def voronoi(frames: DataFrame, p: Profile) -> DataFrame:
    """(match_id, frame_seq, track_id, team, area): areas of the cells of players on the pitch, of frames with 4 or more.

    A frame's cells follow from its own row, so nothing is shuffled: the cells of an Arrow batch are cut out by the
    half-planes of their other sites together, n * n cuts a frame. A site that the others don't surround has an
    unbounded cell, and area 0. Areas are no larger than the pitch.
    """
    sites = frames.withColumn("own", F.filter("players", lambda s: inside(s["x"], s["y"], p))).filter("size(players) >= 4 AND size(own) >= 4")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own")
            many, flat = own.value_lengths().to_numpy(), own.flatten()
            begin = np.cumsum(many) - many
            at = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            area = np.zeros(len(at))
            for n in np.unique(many).tolist():
                rows = begin[many == n][:, None] + np.arange(n)
                area[rows] = areas(at[rows], p.width * p.height)
            frame = np.repeat(np.arange(len(many)), many)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(frame)) for c in ("match_id", "frame_seq")), flat.field("track_id"), flat.field("team"), pa.array(area)], names=["match_id", "frame_seq", "track_id", "team", "area"])

    found = sites.select("match_id", "frame_seq", "own").mapInArrow(work, "match_id long, frame_seq long, track_id long, team string, area double")
    return found.withColumn("area", jround(F.col("area"), 2))


def keyframes(frames: DataFrame, p: Profile, every: int = 5) -> DataFrame:
    """Every fifth frame with 4 players on the pitch, the first of each match up to the cap."""
    full = frames.filter(((F.col("frame_seq") + 1) % every == 0) & (F.size("players") >= 4) & (F.size(F.filter("players", lambda s: inside(s["x"], s["y"], p))) >= 4))
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy("frame_seq"))
    return full.withColumn("at", rank).filter(F.col("at") <= p.zone_cap).drop("at")


def nodes(points: DataFrame, p: Profile) -> DataFrame:
    """(match_id, node_seq, player_id, team, involvement, x, y): players seen 3 times or more, in the order first seen.

    Points are first added up by player and place in the frame: a least frame number can be held in a hash table, a pair of
    frame and place would have all points sorted.
    """
    by_track = p.owner_rule == "first"
    place = F.col("det_ord" if by_track else "i").alias("place")  # both have the same order in a frame
    parts = points.groupBy("match_id", "team", F.col("track_id" if by_track else "i").alias("who"), place).agg(F.min("frame_seq").alias("frame_seq"), F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    key = F.col("who").cast("string") if by_track else F.concat("team", F.lit("_"), (F.col("who") % 11).cast("string"))
    mean = lambda c: jround(jround(F.sum(c) / F.sum("n"), 6), 2).alias(c)
    seen = parts.withColumn("player_id", key).groupBy("match_id", "player_id", "team").agg(F.min(F.struct("frame_seq", "place")).alias("first"), F.sum("n").alias("involvement"), mean("x"), mean("y")).filter("involvement >= 3")
    seq = F.row_number().over(Window.partitionBy("match_id").orderBy("first")).cast("long")
    out = seen.withColumn("node_seq", seq).drop("first")
    return out.filter(F.col("node_seq") <= p.node_cap) if p.cap_before_edges else out


def edges(found: DataFrame, p: Profile) -> DataFrame:
    """(match_id, edge_seq, from_id, to_id, team, count, accuracy): pairs of a side that stand close; joined on match and side."""
    a = found.select("match_id", "team", *[F.col(c).alias(f"a_{c}") for c in ("node_seq", "player_id", "x", "y")])
    b = found.select("match_id", "team", *[F.col(c).alias(f"b_{c}") for c in ("node_seq", "player_id", "x", "y")])
    d = distance(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    near = a.join(b, ["match_id", "team"]).filter("a_node_seq < b_node_seq").withColumn("d", d).filter(F.col("d") < p.edge_distance)
    times = F.lit(10.0) / F.greatest(F.lit(1.0), F.col("d"))
    times = F.floor(times + F.lit(0.5)) if p.edge_round else F.floor(times)
    accuracy = jround(F.least(F.lit(0.95), F.lit(p.accuracy_base) + F.lit(p.accuracy_step) * (F.lit(p.edge_distance) - F.col("d"))), 2)
    seq = F.row_number().over(Window.partitionBy("match_id").orderBy("a_node_seq", "b_node_seq")).cast("long")
    out = near.select("match_id", seq.alias("edge_seq"), F.col("a_player_id").alias("from_id"), F.col("b_player_id").alias("to_id"), "team", F.greatest(F.lit(1), times).cast("long").alias("count"), accuracy.alias("accuracy"))
    return out.filter(F.col("edge_seq") <= p.edge_cap)


def resolved_edges(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges with the places of both ends; edges of which an end is no node are left out."""
    end = lambda name: node.select("match_id", F.col("player_id").alias(f"{name}_id"), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"))
    return edge.join(end("from"), ["match_id", "from_id"]).join(end("to"), ["match_id", "to_id"])


def network_view(node: DataFrame, p: Profile, across: float, down: float) -> DataFrame:
    """Nodes as they are drawn: scaled to the screen, with a radius."""
    return node.select("match_id", "player_id", "team", jround(F.col("x") / F.lit(p.width) * F.lit(across), 2).alias("screen_x"), jround(F.col("y") / F.lit(p.height) * F.lit(down), 2).alias("screen_y"), jround(6 + F.lit(0.8) * F.col("involvement"), 2).alias("radius"))

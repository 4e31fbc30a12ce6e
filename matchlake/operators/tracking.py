"""Tracks of players from boxes: association by overlap in two passes, with constant-velocity prediction.

A match's frames come in order, and all that is kept between two of them are the live tracks (and the lost ones, if
they may return), a handful of numbers each. So a match is never gathered: in a batch its frames stream through one task in sorted order, and as a stream they
arrive in any number of batches, with the tracks as state by match. Both run the same step and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRACKED = "match_id long, frame_seq long, det_ord long, track_no long"
TRACK = "no long, x double, y double, width double, height double, vx double, vy double, seen long"
DETS = "array<struct<det_ord: bigint, x: double, y: double, width: double, height: double, confidence: double>>"


@dataclass(frozen=True)
class Rules:
    #: Detections from `sure` on are matched first and can begin a track; those from `least` on can only go on with one.
    sure: float = 0.5
    least: float = 0.1
    #: Least overlap (intersection over union) with a track's predicted box in the first and in the second pass.
    overlap: float = 0.2
    overlap_unsure: float = 0.5
    #: Frames for which a track that is not seen lives on.
    buffer: int = 30
    #: Weight of the newest step in a track's velocity.
    momentum: float = 0.5
    #: Whether a track that is lost, unseen for over `buffer` frames, goes on when a sure detection that no live track
    #: takes overlaps its predicted box. All tracks of a match are kept then, where else only the live ones are.
    returns: bool = False


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of boxes (centre x, centre y, width, height)."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a.T[:, :, None], b.T[:, None]
    w = np.minimum(ax + aw / 2, bx + bw / 2) - np.maximum(ax - aw / 2, bx - bw / 2)
    h = np.minimum(ay + ah / 2, by + bh / 2) - np.maximum(ay - ah / 2, by - bh / 2)
    both = np.maximum(w, 0) * np.maximum(h, 0)
    union = aw * ah + bw * bh - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def matched(boxes: np.ndarray, found: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs (track, detection) of the largest overlaps first, each used once; ties go to the earlier track, then detection."""
    if not len(boxes) or not len(found):
        return []
    share = overlaps(boxes, found)
    rows, columns = np.nonzero(share >= least)
    pairs, taken, used = [], set(), set()
    for _, i, j in sorted(zip((-share[rows, columns]).tolist(), rows.tolist(), columns.tolist())):
        if i not in taken and j not in used:
            taken.add(i)
            used.add(j)
            pairs.append((i, j))
    return pairs


class Tracker:
    """Live tracks of a match as rows (no, x, y, width, height, vx, vy, seen), the number of the next, and the last frame."""

    def __init__(self, rules: Rules, tracks: np.ndarray | None = None, following: int = 0, last: int = -1):
        self.rules, self.following, self.last = rules, following, last
        self.tracks = np.zeros((0, 8)) if tracks is None else tracks

    def step(self, frame: int, boxes: np.ndarray, confidence: np.ndarray) -> list[int | None]:
        """The track of each box (x, y, width, height) of the next frame; None for those of no track.

        A frame that isn't later than the last one has no tracks: what came after it has been decided.
        """
        out: list[int | None] = [None] * len(boxes)
        if frame <= self.last:
            return out
        r, self.last = self.rules, frame
        live = self.tracks if r.returns else self.tracks[frame - self.tracks[:, 7] <= r.buffer]
        away = frame - live[:, 7]
        near = np.flatnonzero(away <= r.buffer)
        at = np.column_stack([live[:, 1:3] + live[:, 5:7] * away[:, None], live[:, 3:5]])
        sure = np.flatnonzero(confidence >= r.sure)
        unsure = np.flatnonzero((confidence >= r.least) & (confidence < r.sure))
        pairs = [(int(near[i]), int(sure[j])) for i, j in matched(at[near], boxes[sure], r.overlap)]
        free = away == 1  # lost tracks come back by sure detections only
        free[[i for i, _ in pairs]] = False
        rest = np.flatnonzero(free)
        pairs += [(int(rest[i]), int(unsure[j])) for i, j in matched(at[rest], boxes[unsure], r.overlap_unsure)]
        if len(near) < len(live):
            lost, left = np.flatnonzero(away > r.buffer), np.setdiff1d(sure, [j for _, j in pairs])
            pairs += [(int(lost[i]), int(left[j])) for i, j in matched(at[lost], boxes[left], r.overlap)]
        for i, j in pairs:
            moved = (boxes[j, :2] - live[i, 1:3]) / away[i]
            first = not live[i, 5:7].any()
            live[i, 5:7] = moved if first else (1 - r.momentum) * live[i, 5:7] + r.momentum * moved
            live[i, 1:5], live[i, 7] = boxes[j], frame
            out[j] = int(live[i, 0])
        born = [j for j in sure.tolist() if out[j] is None]
        fresh = np.zeros((len(born), 8))
        for row, j in zip(fresh, born):
            out[j], row[0], row[1:5], row[7] = self.following, self.following, boxes[j], frame
            self.following += 1
        self.tracks = np.concatenate([live, fresh])
        return out


def framed(detections: DataFrame, classes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(match_id, frame_seq, dets): a row for each frame with detections of these classes, in their order."""
    own = detections.filter(F.col("class_id").isin(*classes))
    det = F.struct("det_ord", "x", "y", "width", "height", "confidence")
    return own.groupBy("match_id", "frame_seq").agg(F.array_sort(F.collect_list(det)).cast(DETS).alias("dets"))


def _rows(tracker: Tracker, match_id: int, frame: int, dets: list) -> list[tuple]:
    box = np.array([[d["x"], d["y"], d["width"], d["height"]] for d in dets], float).reshape(-1, 4)
    found = tracker.step(frame, box, np.array([d["confidence"] for d in dets], float))
    return [(match_id, frame, d["det_ord"], no) for d, no in zip(dets, found)]


def tracked(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(match_id, frame_seq, det_ord, track_no) from frames(match_id, frame_seq, dets); track_no counts a match's tracks from 0.

    Matches are dealt out and their frames sorted by Spark; a task reads one after the other and holds the live tracks
    of one match. Detections of no track have a null number. An empty table has no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, tracker = None, Tracker(rules)
        for batch in batches:
            dets = batch.column("dets")
            each, sizes = dets.flatten(), dets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            value = lambda c: each.field(c).to_numpy(zero_copy_only=False)
            boxes, sure = np.column_stack([value(c).astype(float) for c in ("x", "y", "width", "height")]), value("confidence").astype(float)
            matches, seqs = batch.column("match_id").to_pylist(), batch.column("frame_seq").to_pylist()
            out: list[int | None] = []
            for m, seq, end, n in zip(matches, seqs, np.cumsum(sizes).tolist(), sizes.tolist()):
                if m != match:
                    match, tracker = m, Tracker(rules)
                out += tracker.step(seq, boxes[end - n : end], sure[end - n : end])
            at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [batch.column("match_id").take(at), batch.column("frame_seq").take(at), each.field("det_ord"), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["match_id", "frame_seq", "det_ord", "track_no"])

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: small frames take long, and would be merged into few tasks
    return frames.select("match_id", "frame_seq", "dets").repartition(parts, "match_id").sortWithinPartitions("match_id", "frame_seq").mapInArrow(work, TRACKED)


class TrackProcessor(StatefulProcessor):
    """The live tracks of a match as list state, and the next number and last frame as value state."""

    def __init__(self, rules: Rules = Rules()):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getListState("tracks", TRACK)
        self.place = handle.getValueState("place", "following long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.tracks.get()] if self.tracks.exists() else []
        following, last = self.place.get() if self.place.exists() else (0, -1)
        tracker = Tracker(self.rules, np.array(held, float).reshape(-1, 8), following, last)
        frames = pd.concat(list(rows)).sort_values("frame_seq", kind="stable")
        out = [r for seq, dets in zip(frames["frame_seq"], frames["dets"]) for r in _rows(tracker, key[0], int(seq), list(dets))]
        kept = [(int(t[0]), *map(float, t[1:7]), int(t[7])) for t in tracker.tracks]
        self.tracks.put(kept) if kept else self.tracks.clear()
        self.place.update((tracker.following, tracker.last))
        yield pd.DataFrame(out, columns=["match_id", "frame_seq", "det_ord", "track_no"]).astype({"track_no": "Int64"})

    def close(self) -> None:
        pass


def tracked_stream(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of tracked() from a stream of frames; a frame that comes after a later one of its match has no tracks."""
    return frames.groupBy("match_id").transformWithStateInPandas(TrackProcessor(rules), TRACKED, "append", "none")

"""Sides of players: given, by image half, or by clusters of jersey features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAST_CROPS, SEED, STARTS, ROUNDS = 500, 42, 10, 300


def last_crops(crops: DataFrame, most: int = LAST_CROPS) -> DataFrame:
    """The last crops of each match(…, seq); Spark keeps no more than these while it sorts."""
    return crops.withColumn("at", F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("seq"))).cast("long")).filter(F.col("at") <= most).drop("at")


def two_means(data: np.ndarray) -> np.ndarray:
    """Cluster (0 or 1) of each row: the best of several starts, each from two rows drawn apart from each other."""
    rng, best, found = np.random.default_rng(SEED), np.inf, np.zeros(len(data), dtype=int)
    apart = lambda centre: ((data - centre) ** 2).sum(axis=1)
    for _ in range(STARTS):
        centres = data[[rng.integers(len(data))]]
        far = apart(centres[0])
        second = rng.choice(len(data), p=far / far.sum()) if far.sum() > 0 else 0
        centres = np.vstack([centres, data[second]])
        for _ in range(ROUNDS):
            gaps = np.stack([apart(c) for c in centres], axis=1)
            own = gaps.argmin(axis=1)
            moved = np.stack([data[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in (0, 1)])
            if np.allclose(moved, centres, rtol=0, atol=1e-9):
                break
            centres = moved
        cost = gaps.min(axis=1).sum()
        if cost < best - 1e-9:
            best, found = cost, own
    return found


def jersey_clusters(crops: DataFrame) -> DataFrame:
    """(match_id, track_id, label) from crops(match_id, track_id, seq, feature array<float>), clustered by match.

    Only the last crops of a match are taken, so that a match is never more than these in a task. The label of a
    track's last crop counts. The cluster of the earliest crop is home (which is which is chance in any clustering); with
    a single feature all are home, and tracks without any have no label. Crops of one seq go by track.
    """

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", "track_id"])
        own = two_means(np.vstack(rows["feature"]).astype(float)) if len(rows) > 1 else np.zeros(1, dtype=int)
        rows = rows.assign(label=np.where(own == own[0], "home", "away"))
        return rows.groupby("track_id", as_index=False).last()[["match_id", "track_id", "label"]]

    kept = last_crops(crops.select("match_id", "track_id", "seq", "feature")).filter("feature IS NOT NULL")
    return kept.groupBy("match_id").applyInPandas(label, "match_id long, track_id long, label string")


def side_of(players: DataFrame, labels: DataFrame) -> DataFrame:
    """Players with the label of their match's track; tracks without one are home. Spark broadcasts labels if they are small."""
    return players.join(labels, ["match_id", "track_id"], "left").withColumn("team_side", F.coalesce("label", F.lit("home"))).drop("label")

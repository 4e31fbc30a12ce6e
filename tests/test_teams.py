"""Jersey colours and clusters."""

import colorsys
import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.functions import colour
from matchlake.operators import teams


def cost(data, own):
    return sum(((data[own == k] - data[own == k].mean(axis=0)) ** 2).sum() for k in (0, 1) if (own == k).any())


def test_two_means_finds_the_best_split():
    rng = np.random.default_rng(1)
    for _ in range(20):
        data = rng.normal(size=(9, 3))
        best = min(cost(data, np.array((0, *rest))) for rest in itertools.product((0, 1), repeat=8))
        assert cost(data, teams.two_means(data)) <= best * 1.15 + 1e-9
    assert set(teams.two_means(np.ones((5, 3)))) == {0}


def test_matches_are_clustered_apart(spark):
    rows = [(m, t, m * 1000 + i, [float(t % 2) * 50 + i % 3, float(m)]) for m in (1, 2) for i, t in enumerate([1, 2, 3, 4] * 5)]
    rows += [(3, 7, 1, [1.0, 1.0]), (4, 8, 1, None)]
    crops = spark.createDataFrame(rows, "match_id long, track_id long, seq long, feature array<float>")
    got = {(r.match_id, r.track_id): r.label for r in teams.jersey_clusters(crops).collect()}
    assert got == {(m, t): "home" if t % 2 else "away" for m in (1, 2) for t in (1, 2, 3, 4)} | {(3, 7): "home"}
    assert teams.jersey_clusters(crops.limit(0)).collect() == []


def test_only_the_last_crops_count(spark):
    rows = [(1, 1, i, [0.0]) for i in range(100)] + [(1, 2, 100 + i, [10.0 * (i % 2)]) for i in range(500)]
    crops = spark.createDataFrame(rows, "match_id long, track_id long, seq long, feature array<float>")
    assert {(r.track_id, r.label) for r in teams.jersey_clusters(crops).collect()} == {(2, "away")}


def test_mean_colour(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (5, 4, 3))
    row = spark.createDataFrame([(image.ravel().tolist(),)], "p array<int>").select(colour.mean_hsv(F.col("p"), F.lit(4), F.lit(5)).alias("f"), colour.mean_hsv(F.col("p"), F.lit(4), F.lit(1)).alias("none")).first()
    want = np.mean([[h * 180, s * 255, v] for h, s, v in (colorsys.rgb_to_hsv(*map(float, px[::-1])) for px in image[:2].reshape(-1, 3))], axis=0)
    assert row.none is None and row.f == pytest.approx(want.tolist(), abs=0.5)


def test_hues_round_by_whole_numbers(spark):
    """Exact halves round up, whatever the floats on the way: 61.5 half degrees are 62."""
    rng = np.random.default_rng(6)
    pixels = [(46, 160, 40), (0, 0, 0), (7, 7, 7), (255, 0, 0), *map(tuple, rng.integers(0, 256, (3000, 3)).tolist())]
    got = [tuple(r.c) for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pixels)], "i int, b int, g int, r int").select("i", colour.hsv(F.col("b"), F.col("g"), F.col("r")).alias("c")).orderBy("i").select("c").collect()]

    def exact(b, g, r):
        most, span = max(b, g, r), max(b, g, r) - min(b, g, r)
        if not span:
            return 0, 0, most
        degrees = Fraction(60 * (g - b), span) % 360 if most == r else 120 + Fraction(60 * (b - r), span) if most == g else 240 + Fraction(60 * (r - g), span)
        return math.floor(degrees / 2 + Fraction(1, 2)) % 180, math.floor(Fraction(255 * span, most) + Fraction(1, 2)), most

    assert got == [exact(*p) for p in pixels] and got[0][0] == 62


def test_clusters_are_no_worse_than_the_librarys(spark, sf_dir):
    """Cost of each match's two clusters against those of pyspark.ml's KMeans on the same crops."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    crops = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("CAST(floor(vec_id / 100) AS LONG) AS match_id", "embedding AS feature")
    for (match,) in crops.select("match_id").distinct().collect():
        own = crops.filter(F.col("match_id") == match)
        data = np.array([r.feature for r in own.collect()], float)
        other = KMeans(k=2, seed=42).fit(own.select(array_to_vector(F.col("feature").cast("array<double>")).alias("features"))).summary.trainingCost
        assert cost(data, teams.two_means(data)) <= other * 1.0001

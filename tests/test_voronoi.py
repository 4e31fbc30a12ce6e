"""Voronoi areas against cells that are cut out of a very large square, one bisector after the other."""

import random

from matchlake.operators import spatial
from matchlake.plans.profiles import FIVE

FAR = 1e7


def cell(site, others):
    """Corners of the part of the square that is nearer to site than to any other."""
    shape = [(-FAR, -FAR), (FAR, -FAR), (FAR, FAR), (-FAR, FAR)]
    for ox, oy in others:
        a, b = ox - site[0], oy - site[1]
        c = (ox * ox + oy * oy - site[0] ** 2 - site[1] ** 2) / 2
        side = [a * x + b * y - c for x, y in shape]
        out = []
        for i, p in enumerate(shape):
            q, s, t = shape[i - 1], side[i - 1], side[i]
            if (s <= 0) != (t <= 0):
                k = s / (s - t)
                out.append((q[0] + k * (p[0] - q[0]), q[1] + k * (p[1] - q[1])))
            if t <= 0:
                out.append(p)
        shape = out
    return shape


def test_areas_are_those_of_the_clipped_cells(spark):
    rng = random.Random(21)
    frames, want = [], {}
    for f in range(25):
        n = rng.randint(4, 12)
        points = [(rng.uniform(0, FIVE.width), rng.uniform(0, FIVE.height)) for _ in range(n)]
        frames.append((1, f, [(k, x, y, "home", 100 + k) for k, (x, y) in enumerate(points)]))
        for k, p in enumerate(points):
            shape = cell(p, points[:k] + points[k + 1 :])
            bounded = all(abs(v) < FAR / 10 for c in shape for v in c)
            area = abs(sum(shape[i - 1][0] * c[1] - c[0] * shape[i - 1][1] for i, c in enumerate(shape))) / 2
            want[f, 100 + k] = min(area, FIVE.width * FIVE.height) if bounded else 0.0
    schema = "match_id long, frame_seq long, players array<struct<det_ord: long, x: double, y: double, team: string, track_id: long>>"
    got = {(r.frame_seq, r.track_id): r.area for r in spatial.voronoi(spark.createDataFrame(frames, schema), FIVE).collect()}
    assert got.keys() == want.keys() and sum(a > 0 for a in want.values()) > 30
    wrong = {k: (got[k], want[k]) for k in want if abs(got[k] - want[k]) > 0.0101}
    assert not wrong

"""Column functions on pitch coordinates. Only +, -, *, / and sqrt, so that other engines give the same bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.plans.profiles import Profile


def jround(x: Column, digits: int) -> Column:
    """Half up on the scaled value, as Math.round does."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def fixed(x: Column, digits: int) -> Column:
    """Rounded half up, then written with that many decimals."""
    return F.format_string(f"%.{digits}f", jround(x, digits))


def to_pitch(x: Column, size: float, metres: float) -> Column:
    return x / F.lit(float(size)) * F.lit(float(metres))


def homography(x: Column, y: Column, h: Column) -> tuple[Column, Column]:
    """Perspective transform by the row-major 3x3 array h, on 32-bit inputs; null where the denominator is 0."""
    x, y = x.cast("float").cast("double"), y.cast("float").cast("double")
    under = h[6] * x + h[7] * y + h[8]
    under = F.when(under != 0, under)
    return (h[0] * x + h[1] * y + h[2]) / under, (h[3] * x + h[4] * y + h[5]) / under


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def goal_x(side: Column, p: Profile) -> Column:
    """The goal that a side attacks."""
    return F.when(side == "home", F.lit(p.width)).otherwise(F.lit(0.0))


def xg(x: Column, y: Column, gx: Column, p: Profile) -> Column:
    d = distance(x, y, gx, F.lit(p.height / 2))
    angle = F.atan2(F.abs(y - F.lit(p.height / 2)), F.abs(x - gx))
    odds = F.lit(p.xg_base) - F.lit(p.xg_distance) * d - F.lit(p.xg_angle) * angle
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 / (1 + F.exp(-odds))))


def near_corner(x: Column, y: Column, p: Profile) -> Column:
    w, h, o = F.lit(p.width), F.lit(p.height), F.lit(0.0)
    return F.least(*[distance(x, y, cx, cy) for cx, cy in ((o, o), (w, o), (o, h), (w, h))]) < F.lit(p.corner_radius)


def half_team(x: Column, frame_w: float) -> Column:
    return F.when(x < F.lit(frame_w / 2), "home").otherwise("away")


def inside(x: Column, y: Column, p: Profile) -> Column:
    return x.between(0.0, p.width) & y.between(0.0, p.height)


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Whole-pixel crop of a box from 0 on, and whether anything is left of it."""
    a, b, c, d = F.greatest(F.lit(0), x1.cast("int")), F.greatest(F.lit(0), y1.cast("int")), x2.cast("int"), y2.cast("int")
    return a, b, c, d, (c > a) & (d > b)

"""Colours of image crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hsv(blue: Column, green: Column, red: Column) -> Column:
    """Hue in half degrees and saturation and value up to 255, rounded half up, of a colour in bytes; whole numbers throughout."""
    blue, green, red = (c.cast("long") for c in (blue, green, red))
    most, least = F.greatest(blue, green, red), F.least(blue, green, red)
    span = most - least
    along = F.when(most == red, green - blue).when(most == green, blue - red).otherwise(red - green)
    base = F.when((most == red) & (along >= 0), 0).when(most == red, 360).when(most == green, 120).otherwise(240)
    whole = lambda above, below: F.when(below == 0, F.lit(0)).otherwise(F.floor((2 * above + below) / F.greatest(F.lit(1), 2 * below)))
    half = whole(60 * along + base * span, 2 * span) % 180
    return F.struct(half.cast("double").alias("h"), whole(255 * span, most).cast("double").alias("s"), most.cast("double").alias("v"))


def mean_hsv(pixels: Column, width: Column, height: Column) -> Column:
    """Mean hue, saturation and value of the upper half of a crop (blue, green, red bytes, row by row); null if it is empty."""
    n = (F.floor(height / 2) * width).cast("int")
    at = lambda i, c: F.get(pixels, i * 3 + c)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: hsv(at(i, 0), at(i, 1), at(i, 2)))
    mean = lambda name: F.aggregate(each, F.lit(0.0), lambda t, c: t + c[name]) / n
    return F.when(n > 0, F.array(mean("h"), mean("s"), mean("v")))

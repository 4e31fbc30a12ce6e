"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import cut, hot_keys, join_apart, join_hot


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of edges(u, v); root is the least node reachable.

    Each round takes the least label among the neighbours and then the label of that label, so stars settle at once
    and chains in about the logarithm of their length. Only sums per round reach the driver. No edges: no rows.
    """
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct())
    label = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root")))
    hubs = hot_keys(both, "v")  # the middle of a large star has a row for each of its ends
    while True:
        near = join_apart(both, label.withColumnRenamed("node", "v"), "v", hubs).groupBy("u").agg(F.min("root").alias("near"))
        hooked = cut(label.join(near, label.node == near.u).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = cut(join_hot(hooked, up, "root", "left").select("node", "was", F.least("root", F.coalesce("above", "root")).alias("root")))
        if moved.filter("was <> root").isEmpty():
            return moved.select("node", "root")
        label = moved.select("node", "root")

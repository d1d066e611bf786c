"""Connected components by minimum labels and pointer jumping, in DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarframe.plans.tables import settle


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every node of an edge; component is the smallest id reachable, in any direction.

    Every round takes each node's smallest neighbouring label (a partial aggregate, so a hub
    costs one row per map task), then lets labels point at their own label, which halves long
    chains.  The loop ends with the round that changes no label.  Null ends are ignored.
    """
    there = settle(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "pairs")
    both = settle(there.union(there.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settle(there.select(F.col("a").alias("id")).union(there.select("b")).groupBy("id").agg(F.first("id").alias("component")), "labels")
    while True:
        near = both.join(labels, both.a == labels.id).groupBy("b").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.id == near.b, "left").select("id", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        hop = labels.select(F.col("id").alias("via"), F.col("component").alias("hop"))
        new = settle(low.join(hop, low.low == hop.via).select("id", "old", F.least("low", "hop").alias("component")), "labels")
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")

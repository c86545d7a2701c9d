"""Connected components of a table of edges, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each end of an edge (a, b) the smallest end that it is connected with.

    In each round a vertex takes the least label among its neighbours, and then that label's own label. Labels and edges
    stay on shared storage; nothing is collected but whether a round has changed anything.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("m"))
        least = near.join(labels, near["a"] == labels["v"]).select("v", F.least("label", "m").alias("hop"), F.col("label").alias("old"))
        up = labels.select(F.col("v").alias("hop"), F.col("label").alias("up"))
        new = stored(least.join(up, "hop", "left").select("v", F.least("hop", F.coalesce("up", "hop")).alias("label"), "old"), "labels")
        settled = new.filter("label <> old").isEmpty()
        discard(labels)
        if settled:
            discard(both)
            return new.select("v", "label")
        labels = new

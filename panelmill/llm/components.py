"""Connected components of undirected links by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id and component (the smallest id reachable, itself included) of every end of links (a, b) of two ids.

    Each round takes the smallest label among neighbours and then that label's own label, so long chains take a number
    of rounds that grows with the logarithm of their length. Labels are written to the shared folder in each round, and
    the last ones stay there as components.
    """
    links = links.where("a <> b").select("a", "b")
    pairs = scratch.write(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = scratch.write(pairs.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "components")
    while True:
        near = pairs.join(labels.select(F.col("id").alias("b"), F.col("component").alias("next")), "b").groupBy("a").agg(F.min("next").alias("next"))
        met = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", "component", F.least("component", "next").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("over"))
        moved = scratch.write(met.join(up, "low").select("id", F.col("component").alias("was"), F.least("low", "over").alias("component")), "moved")
        scratch.free("components")
        scratch.paths["components"] = scratch.paths.pop("moved")
        changed, labels = moved.where("component <> was").limit(1).count(), moved.select("id", "component")
        if not changed:
            scratch.free("pairs")
            return labels

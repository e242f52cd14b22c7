"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodweave.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node of ``edges`` with the smallest node it can reach.

    Each round takes the smallest label among the neighbours and then the
    label of that label, so chains shrink by doubling.  A round is written to
    the shared folder, so an executor loss never replays earlier
    rounds.  Links and labels stay distributed.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    both = written(both, "graph-edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("c")), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("c").alias("m"))
        low = labels.join(near, "x").select("x", F.col("c").alias("was"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("x").alias("c"), F.col("c").alias("cc"))
        new = written(low.join(up, "c").select("x", "was", F.least("c", "cc").alias("c")), "graph-labels")
        labels = new.drop("was")
        if new.where("c <> was").isEmpty():
            return labels.select(F.col("x").alias("id"), F.col("c").alias("component"))


def merge_components(labels: DataFrame, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``labels`` (id, component) after more links; only the components that the links touch are walked again."""
    low = lambda c, out: labels.select(F.col("id").alias(c), F.col("component").alias(out))
    ends = edges.select(F.col(a).alias("p"), F.col(b).alias("q")) \
        .join(low("p", "cp"), "p", "left").join(low("q", "cq"), "q", "left") \
        .select("p", "q", F.coalesce("cp", "p").alias("cp"), F.coalesce("cq", "q").alias("cq"))
    ends = written(ends, "graph-ends")
    if ends.isEmpty():
        return labels
    merged = components(ends.where("cp <> cq").select("cp", "cq").distinct(), "cp", "cq")
    nodes = labels.unionByName(ends.select(F.col("p").alias("id"), F.col("cp").alias("component"))) \
        .unionByName(ends.select(F.col("q").alias("id"), F.col("cq").alias("component"))).distinct()
    return nodes.join(merged.select(F.col("id").alias("component"), F.col("component").alias("low")), "component", "left") \
        .select("id", F.coalesce("low", "component").alias("component"))

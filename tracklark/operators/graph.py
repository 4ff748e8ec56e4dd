"""Components by minimum-label propagation, for overlap graphs, bonds and pixel neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.session import discard, materialize


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component); edges (a, b) hold in both directions.

    Each round takes the least label among neighbours and then the label of that label, so labels travel twice as far
    each time. Rounds are written to the shared folder until nothing changes.
    """
    spark = nodes.sparkSession
    both, edges_at = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    now, at = materialize(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = now.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after, after_at = materialize(low.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        discard(spark, at)
        now, at = after.select("node", "label"), after_at
        if after.where("old <> label").isEmpty():
            discard(spark, edges_at)
            return now

"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklark.llm.batches import mapped
from tracklark.session import discard, materialize, small_enough

#: A contracted graph of so many edges at most is finished by one task, which then holds some tens of megabytes.
ONE_TASK = 1_000_000


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root of all nodes of the edges (a, b) in this task, the root being the smallest node."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = find(a), find(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["node", "root"])


def roots(edges: DataFrame, one_task: int = ONE_TASK) -> tuple[DataFrame, str]:
    """node and root of each node with an edge (a, b), and the path of that table.

    Each round lets every node follow its smallest neighbour, if that is smaller, and contracts the graph to the nodes
    followed; ids are hashes, so the number of nodes falls by a constant factor in each round. Once `one_task` edges or
    fewer are left, one task joins them. Tables of a round are written to the shared folder; nothing is collected.
    """
    spark = edges.sparkSession
    left, held = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    lead, paths = None, []
    while not small_enough(left, one_task):
        step, path = materialize(
            left.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("to"))).groupBy("node").agg(F.min("to").alias("to"))
        )
        paths.append(path)
        lead = followed(lead, step)
        moved = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left, after = materialize(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(spark, held)
        held = after
    last = mapped(left.coalesce(1), finished, "node long, root long")
    out, path = materialize(followed(lead, last.withColumnRenamed("root", "to")))
    discard(spark, held, *paths)
    return out, path


def followed(lead: DataFrame | None, step: DataFrame) -> DataFrame:
    """Each node's root after one more step (node, to)."""
    if lead is None:
        return step.select("node", F.col("to").alias("root"))
    return lead.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))

"""Fixpoint over an edge table by semi-naive rounds; each round is written to the shared folder, so its lineage is a few steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def grow(seeds: DataFrame, edges: DataFrame, steps: int = 4) -> DataFrame:
    """Nodes reachable from the seeds (column node) over edges (src, dst), seeds included.

    A round takes `steps` edges further and is then written; rounds go on until one finds nothing new, however deep the graph.
    """
    edges = written(edges.select("src", "dst").filter("src <> dst").distinct())
    reached = new = written(seeds.select("node").filter("node IS NOT NULL").distinct())
    parts = 1
    while True:
        front, found = new, []
        for _ in range(steps):
            front = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
            found.append(front)
        step = found[0]
        for f in found[1:]:
            step = step.unionByName(f)
        # only what stands last can lead on, but any of a round's nodes may be met again on a shorter way
        new = written(step.distinct().join(reached, "node", "left_anti"))
        if new.isEmpty():
            return reached
        reached, parts = reached.unionByName(new), parts + 1
        if parts % 16 == 0:
            reached = written(reached)

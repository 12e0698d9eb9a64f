"""Connected components of a large graph, as joins and grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import map_batches, staged

#: So many edges at most are joined up by one task.
FEW = 16_000


def _united(batches):
    """The components of a few edges, by union-find."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    nodes = np.array(sorted(above), np.int64)
    labels = np.array([root(x) for x in nodes.tolist()], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` for each node of ``edges`` (bigint ``a`` and ``b``): the smallest node it reaches.

    Up to ``FEW`` edges go to one task. Beyond, joins and grouping do it:
    Each round takes the smallest label next to a node, then the label of that label, so chains
    shrink by a factor a round. Every round is a stored table. Hubs only meet partial
    aggregations, and joins in which the other side has one row a node.
    """
    edges = staged(edges.select("a", "b"))
    if edges.count() <= FEW:
        return staged(map_batches(edges.coalesce(1), _united, "node long, label long"))
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    last = None
    while (now := labels.agg(total).first()[0]) != last:
        last = now
        told = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        nearest = staged(labels.unionByName(told).groupBy("node").agg(F.min("label").alias("label")))
        ahead = nearest.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = staged(nearest.join(ahead, "label").select("node", F.col("further").alias("label")))
    return labels

"""Connected components: in one task while the counted edges are few, by distributed min-label rounds beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linkforge.runtime import checkpointed, ship

#: Edges (16 bytes each) that one task settles. Rounds would cost the driver a dozen stages each, whatever the edges.
TASK_EDGES = 500_000


def settled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The endpoints of edges and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[one], root[other]), np.maximum(root[one], root[other])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[root]
        # roots hook onto smaller roots only, so there is no circle; then every node jumps to its root
        np.minimum.at(root, high[open_], low[open_])
        while not np.array_equal(root, jumped := root[root]):
            root = jumped


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
    if held:
        nodes, labels = settled(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])


def connected(edges: DataFrame, most_rounds: int = 64, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label) for every endpoint of ``edges`` (a, b; long): label is the smallest node reachable.

    Up to ``task_edges`` edges are settled in one task. Beyond, each round joins every node's neighbours to their
    smallest label and then jumps to the label's own label, so long chains halve. Rounds are cut by reliable
    checkpoints. Empty edges give an empty table; loops and repeated edges do no harm.
    """
    edges = checkpointed(edges.where("a is not null and b is not null and a != b").select("a", "b"))
    if edges.count() <= task_edges:
        ship(edges.sparkSession)
        return checkpointed(edges.coalesce(1).mapInArrow(_settle, "node long, label long"))
    both = checkpointed(
        edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct()
    )
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        # hooking: what a member sees, its root learns; then every node jumps to its root's label
        roots = lower.groupBy("label").agg(F.min("low").alias("root"))
        new = lower.join(roots, "label").select("node", F.least("low", "root").alias("next"), F.col("label").alias("was"))
        ahead = new.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        new = new.join(ahead, "next", "left").select("node", F.coalesce("jump", "next").alias("label"), "was")
        new = checkpointed(new)
        labels = new.select("node", "label")
        if new.where("label != was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels

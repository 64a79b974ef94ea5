"""Connected components of links, by alternating star contraction; nothing is gathered on the driver.

Each partition first replaces its links by a spanning star of each of its own components, so that what moves is bounded by
the nodes.  Then two rules alternate until nothing changes: every node hands its larger neighbours to its smallest one,
and its smaller neighbours (with itself) to the smallest of them.  Tables are written between rounds, so a lost executor
costs a reread, and joins on a node that a third of all links share can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.scratch import Scratch


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but roots; a root is the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    away = root != np.arange(len(nodes))
    return nodes[away], nodes[root[away]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contracts each million links, so memory stays bounded."""
    held: list[np.ndarray] = []

    def star() -> pa.RecordBatch:
        links = np.concatenate(held)
        node, root = star_forest(links[:, 0], links[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
        if sum(map(len, held)) >= 1_000_000:
            yield star()
            held = []
    if held:
        yield star()


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long).  Returns node, root for every node of a link but the roots; a root is the smallest node it reaches."""
    scratch = Scratch(links.sparkSession)
    edges = scratch.cut(links.where("u <> v").select("u", "v").mapInArrow(_local, "u long, v long"))
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.union(edges.select("v", "u"))
        low = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = scratch.cut(small)
        scratch.drop(edges, low, large, low2)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

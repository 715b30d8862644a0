"""Connected components of a link table, in Spark.

Tasks first contract the links they hold to trees (union-find over one partition), then large-star and small-star rounds
(every node hands its neighbours to the least of them) run until the links are stars. Links stay in tables; neither
links nor components reach the driver, which only compares two sums a round. The least neighbour of each node is written
before it is joined back, so that Spark may split a hot node's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kestrion.llm.common import trimmed
from kestrion.sources.scratch import Scratch


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes that aren't the least themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
        np.minimum.at(parent, high, low)
        while (up := parent[parent] != parent).any():
            parent = np.where(up, parent[parent], parent)
        keep = parent[x] != parent[y]
        x, y = x[keep], y[keep]
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def contract(links: DataFrame) -> DataFrame:
    """The links (a, b) of each partition as a forest of stars: same components, one row a node at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = union_find(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links.select("a", "b").mapInArrow(trimmed(run), "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b), the least itself left out."""

    def star(edges: DataFrame, name: str) -> DataFrame:
        """Each (a, b) with the least of a and a's b's in place of a."""
        least = scratch.keep(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        out = scratch.keep(edges.join(least, "a").select("a", "b", "m"), name)
        scratch.drop(least)
        return out

    now = scratch.keep(contract(links.where("a <> b")).distinct(), "links")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, "large")
        down = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = star(down, "small")
        made = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = scratch.keep(made, "links")
        scratch.drop(large, small, now)
        now = new
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sums == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = sums

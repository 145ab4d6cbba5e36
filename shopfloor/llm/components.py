"""Connected components of an edge table.

Each task first reduces its own edges to a forest (a vectorised union-find over at most some TASK_EDGES
edges). Where one task holds all edges that is the result; else the forests meet in alternating large-star and
small-star steps, which group edges by a node with a minimum (combined before the shuffle) and join it back.
Nothing is collected. A node with very many neighbours meets its minimum in a join, which Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shopfloor.llm.store import keep, keep_counted

TASK_EDGES = 1 << 20


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`parent` (each place's smallest known companion) after joining a[i] with b[i]."""
    while True:
        x, y = parent[a], parent[b]
        differ = x != y
        if not differ.any():
            return parent
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def forest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, smallest node that the edges of this task connect it with)"""
    met = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches if batch.num_rows]
    if not met:
        return
    a, b = map(np.concatenate, zip(*met))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = unite(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[parent[moved]])], ["a", "b"])


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> node, component: the smallest node of the component, for each node but that one."""
    now, (n,) = keep_counted(edges.filter("a <> b").select("a", "b"), "edges")
    tasks = max(1, -(-n // TASK_EDGES))
    now = keep(now.coalesce(tasks).mapInArrow(forest_rows, "a long, b long"), "forest")
    seen = None
    while tasks > 1:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _star(large, low).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now, state = keep_counted(small, "star", F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))

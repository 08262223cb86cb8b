"""Connected components of an edge table: slices are contracted in tasks, alternating stars tie the slices together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Edges that a task contracts together.
SLICE = 400_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of some edges as stars: (least node, other node) for all nodes but the least ones."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        open_ = x != y
        if not open_.any():
            break
        u, v = u[open_], v[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of each slice of a task's edges."""

    def out(parts):
        a, b = stars(*(np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= SLICE:
            yield out(held)
            held, rows = [], 0
    if held:
        yield out(held)


EDGES = "a long, b long"


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    sides = _both(edges)
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return sides.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return tied.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is the least of its stars or belongs to one star only."""
    nodes = edges.select(F.col("a").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("top")).union(edges.select("b", F.lit(1), F.lit(0)))
    bad = nodes.groupBy("u").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where("n > 1 or n > 0 and top > 0")
    return not bad.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges`` (a, b): the least node that can be reached.

    A task turns slices of at most SLICE edges into stars, which leaves no more edges than nodes. While there is more
    than one slice, a round of alternating stars, a few joins and aggregations, ties them together; rounds grow as the
    logarithm of the longest path. Each is written to the shared folder, which ends its lineage. Edges from a node to
    itself, with a null end or that are repeated add nothing. An empty table gives no rows.
    """
    now = stored(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(contracted, EDGES))
    while True:
        slices = -(-now.count() // SLICE)
        now = stored(now.coalesce(max(1, slices)).mapInArrow(contracted, EDGES))
        if slices <= 1 or _are_stars(now):
            break
        now = stored(_small_star(_large_star(now.distinct()).distinct()).where("a <> b").distinct())
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots)

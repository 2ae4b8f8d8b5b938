"""Connected components of an edge table: contracted inside tasks first, then by alternating star contraction.

A task turns its edges into stars, each node beside the least one it is linked to there. A node has one star a task then, so
the stars of a node are few, even a hub's. Where they differ, their centres are the edges of a smaller graph, which is
contracted in the same way. That halves most graphs at least, with one shuffle a level; where it doesn't (a chain whose edges
lie in different tasks all), star rounds settle what is left. Every level and round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnframe.llm.common import written

#: Edges that a task contracts at a time; it gives out its stars once they have so many nodes.
EDGES = 1 << 20


def _starred(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its neighbours. The aggregate is small; a hub's rows stay on the splittable side of the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the least node that each is linked to."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while len(np.flatnonzero((up := least[least]) != least)):
            least = up
        a, b = least[a], least[b]
        a, b = a[apart := a != b], b[apart]
    return nodes, nodes[least]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) to stars (node, least) of this task."""
    u, v, parts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        parts.append([batch.column(c).to_numpy() for c in "uv"])
        waiting += batch.num_rows
        if waiting >= EDGES:
            u, v = stars(*(np.concatenate(x) for x in zip((u, v), *parts)))
            parts, waiting = [], 0
            if len(u) >= EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["node", "least"])
                u, v = u[:0], v[:0]
    if parts:
        u, v = stars(*(np.concatenate(x) for x in zip((u, v), *parts)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["node", "least"])


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of edges (u, v), longs: component is the smallest node reachable.

    Self-loops, repeated and reversed edges are allowed, but a node of self-loops alone has no row; an edge with a null end is
    ignored; no edges give no rows.
    """
    now, before, levels = edges.select("u", "v").where("u <> v"), None, []
    while True:
        each = now.mapInArrow(_contracted, "node long, least long").groupBy("node").agg(F.collect_set("least").alias("all"))
        level = written(each.select("node", F.array_min("all").alias("least"), F.array_except("all", F.array(F.array_min("all"))).alias("more")), "stars")
        levels.append(level.select("node", "least"))
        now = level.select(F.col("least").alias("v"), F.explode("more").alias("u"))
        left = level.agg(F.sum(F.size("more"))).first()[0] or 0
        if not left or before is not None and 2 * left > before:
            break
        before = left
    known = star_rounds(now, most_rounds) if left else None
    for level in reversed(levels):  # the centres of a level are nodes of the next, or stand alone
        if known is not None:
            level = level.join(known.withColumnRenamed("node", "least"), "least", "left").select("node", F.coalesce("component", "least").alias("component"))
        known = level.select("node", level[level.columns[1]].alias("component"))
    return known


def star_rounds(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """Like components. Large-star and small-star rounds alternate until nothing changes; each takes time in proportion to the
    edges, and the rounds grow with the logarithm of the longest path.
    """
    now = written(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        large = _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every row of large has v < u, so the neighbours of u that are no larger are all its v
        starred = _starred(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).union(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())

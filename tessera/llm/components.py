"""Connected components of a link table, by local union-find and star contraction.

Each task first runs union-find over its links and passes on one link per node (node,
smallest node of its tree). Large-star and small-star steps then hook every node to
the smallest node of its component; each step is an aggregate (combined in the tasks)
and a join on written tables, so a node with very many links is split over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_arrow, materialize

LINKS_AT_ONCE = 500_000    # links in one union-find of a task


def _roots(a: list[int], b: list[int]) -> dict[int, int]:
    """Union-find over links: node -> smallest node of its tree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return {x: find(x) for x in parent}


def _forest(links: DataFrame) -> DataFrame:
    def run(batches):
        a, b = [], []

        def out():
            tree = [(x, r) for x, r in _roots(a, b).items() if x != r]
            return pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in tree], pa.int64()), pa.array([r for _, r in tree], pa.int64())],
                ["a", "b"])

        for batch in batches:
            a += column(batch, "a").to_pylist()
            b += column(batch, "b").to_pylist()
            if len(a) > LINKS_AT_ONCE:
                yield out()
                a, b = [], []
        if a:
            yield out()

    return map_arrow(links.select("a", "b"), run, "a long, b long")


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hook nodes to their smallest neighbour (links run from larger ``a`` to smaller ``b``)."""
    if large:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = materialize(near.groupBy("u").agg(F.min("v").alias("m"))
                        .select("u", F.least("u", "m").alias("m")), "least")
    joined = near.join(least, "u")
    moved = joined.filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(
        F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    if large:      # one row per link at most; repeats end in the small step that follows
        return materialize(moved, "star")
    return materialize(moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")
                       .distinct(), "star")


def _is_star_forest(links: DataFrame) -> bool:
    """Whether every node that hooks on something hooks on one node, which is a root."""
    ends = links.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("b", F.lit(0), F.lit(1)))
    bent = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter(
        "up > 1 or up = 1 and down = 1")
    return bent.count() == 0


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node with a link; the
    links are rows ``a, b`` of 64-bit ids (either way round, repeats allowed)."""
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialize(_forest(ordered).distinct(), "forest")
    while not _is_star_forest(e):
        e = _star(_star(e, large=True), large=False)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select("b", "b").distinct())

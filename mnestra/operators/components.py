"""Connected components by alternating star contractions.

Each round is two aggregations over the edges; the number of rounds grows with
the logarithm of the longest path, and no task holds more than one node's
aggregate.  Where edges come in groups that no component leaves, groups of at most
``GROUP_EDGES`` edges are joined in one task each, and only larger ones go the rounds.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnestra.session import materialise

GROUP_EDGES = 500_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of every node to the least node among them."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    if large:
        both = both.union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
    joined = both.join(least, "n")
    if large:
        moved = joined.filter("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        moved = joined.select(F.col("m").alias("u"), F.col("least").alias("v")).union(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return moved.filter("u <> v").distinct()


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pd.DataFrame({"node": nodes, "component": [find(n) for n in nodes]}, dtype="int64")


def connected_components(edges: DataFrame, max_rounds: int = 60, group: str | None = None, group_edges: int = GROUP_EDGES) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``, component being its least node.

    ``group`` may name a column of which no component has two values.

    Only nodes that have an edge are listed; an edge with a null end or from a
    node to itself joins nothing (such a node is listed as its own component).
    Raises if the components do not rest within ``max_rounds``, which suffice for paths of 2 ** 30 edges and more.
    """
    if group is not None:
        clean = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col(group).alias("g")).filter("u is not null and v is not null").distinct()
        clean = materialise(clean, "edges")
        sized = clean.groupBy(F.col("g").alias("_g")).agg((F.count(F.lit(1)) > group_edges).alias("large"))
        placed = clean.join(sized, F.col("g").eqNullSafe(F.col("_g"))).select("g", "u", "v", "large")
        small = placed.filter("not large").groupBy("g").applyInPandas(_joined, "node long, component long")
        if not sized.filter("large").limit(1).count():
            return small
        return small.unionByName(connected_components(placed.filter("large").select(F.col("u").alias("src"), F.col("v").alias("dst")), max_rounds))
    clean = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter("u is not null and v is not null")
    nodes = clean.select(F.col("u").alias("node")).union(clean.select("v")).distinct()
    current = materialise(clean.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        current = materialise(_star(_star(current, True), False), "edges")
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not rest within {max_rounds} rounds")
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))

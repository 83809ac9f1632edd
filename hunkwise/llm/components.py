"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm.common import Staged


def flattened(hooks: DataFrame, staged: Staged) -> DataFrame:
    """(node, up) with every ``up`` a root: hooks are followed by pointer jumping, each pass doubles what they skip. Only targets that are
    no roots themselves take part, one row each, so a node that very many others hook to is never a join key when it is a root."""
    while True:
        targets = hooks.select(F.col("up").alias("target")).distinct()
        inner = staged.put(targets.join(hooks.withColumnRenamed("up", "further"), F.col("target") == F.col("node"))
                           .where("target <> further").select("target", "further"), "inner")
        if not inner.head(1):
            staged.drop(inner)
            return hooks
        nxt = staged.put(hooks.join(inner, F.col("up") == F.col("target"), "left").select("node", F.coalesce("further", "up").alias("up")), "hooks")
        staged.drop(hooks, inner)
        hooks = nxt


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends and contracts the edges. A node with edges
    left hooks or is hooked to, so at least half of them vanish: rounds grow with the logarithm of the nodes, and the jumps
    of a round with the logarithm of its longest chain of hooks. Hooking pre-aggregates per node before it shuffles. Nodes without
    edges have no row; null ends are ignored.
    """
    live = staged.put(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while live.head(1):
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = flattened(staged.put(both.groupBy("a").agg(F.min("b").alias("least"))
                                     .select(F.col("a").alias("node"), F.least("a", "least").alias("up")), "hooks"), staged)
        if labels is None:
            fresh = staged.put(hooks.select("node", F.col("up").alias("root")), "labels")
        else:
            up = hooks.select(F.col("node").alias("root"), "up")
            fresh = staged.put(labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            staged.drop(labels)
        labels = fresh
        left = hooks.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = hooks.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = live.join(left, "a").join(right, "b").where("x <> y")
        nxt = staged.put(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        staged.drop(live, hooks)
        live = nxt
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels

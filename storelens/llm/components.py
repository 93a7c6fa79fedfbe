"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _shortcut(parent: DataFrame) -> DataFrame:
    """Replace each ``root`` by its own root until nothing changes (depth halves each time)."""
    while True:
        up = parent.select(F.col("node").alias("at"), F.col("root").alias("top"))
        parent = cut(parent.join(up, parent["root"] == up["at"]).select(
            "node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "cc-parent")
        if parent.where("moved").isEmpty():
            return parent.select("node", "root")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``; ``root`` is the least node of its component.

    Each round hooks every remaining root to its least neighbour, flattens the trees by pointer
    jumping and contracts the edges; rounds grow with the logarithm of the number of nodes.
    Minima are aggregated before the shuffle and both sides of each join are written tables,
    so a node with very many edges is split over tasks. Nulls and loops are left out.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "cc-edges")
    roots = None
    while True:
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("root"))
        hook = _shortcut(cut(hook, "cc-hook"))
        if roots is None:
            roots = hook
        else:
            new = hook.select(F.col("node").alias("at"), F.col("root").alias("top"))
            roots = cut(roots.join(new, roots["root"] == new["at"], "left").select(
                "node", F.coalesce("top", "root").alias("root")), "cc-roots")
        ra, rb = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        edges = cut(edges.join(ra, "a").join(rb, "b").where("ra <> rb").select(
            F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "cc-edges")
        if edges.isEmpty():
            return roots

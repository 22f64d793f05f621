"""Connected components by contraction: every round each node follows a neighbour of least rank, and edges shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of `edges` (a long, b long): nodes are connected exactly if their roots agree.

    Ranks are hashes salted by the round, so a chain shrinks by a constant factor a round in expectation, whatever the
    order of its ids. A hub's neighbours are reduced where they lie before the shuffle. Loops and repeated edges are
    allowed; no edges give no rows.
    """
    edges = checkpoint(edges.select("a", "b").filter("a <> b").distinct())
    roots = checkpoint(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    step = 0
    while not edges.isEmpty():
        step += 1
        rank = lambda node: F.struct(F.xxhash64(F.col(node), F.lit(step)).alias("rank"), F.col(node).alias("to"))  # noqa: B023, E731
        both = edges.select("a", rank("b").alias("next")).union(edges.select("b", rank("a")))
        follow = both.groupBy(F.col("a").alias("node")).agg(F.min("next").alias("next"))
        # A node of lower rank than all its neighbours stays where it is.
        follow = checkpoint(follow.select("node", F.least(F.col("next"), rank("node"))["to"].alias("next")))
        at = lambda side: follow.select(F.col("node").alias(side), F.col("next").alias(f"{side}_next"))  # noqa: B023, E731
        edges = checkpoint(
            edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_next").alias("a"), F.col("b_next").alias("b")).filter("a <> b").distinct()
        )
        moved = follow.select(F.col("node").alias("root"), "next")
        roots = checkpoint(roots.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return roots

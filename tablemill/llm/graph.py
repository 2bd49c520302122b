"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share the root.

    Each round every node points to the neighbour (or itself) that comes first in an order dealt anew
    by a hash, pointers are followed once more, and the edges between the nodes pointed to go on.  The
    graph shrinks by a constant factor a round; every round is a table in the shared folder.
    """
    edges = stage(edges.where("a <> b").select("a", "b").distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64(F.lit(turn), "b").alias("h"), F.col("b").alias("id"))
        own = F.struct(F.xxhash64(F.lit(turn), "a").alias("h"), F.col("a").alias("id"))
        points = both.groupBy("a").agg(F.min(order).alias("first"))
        points = stage(points.select(F.col("a").alias("node"), F.least("first", own)["id"].alias("to")), "points")
        again = points.select(F.col("node").alias("mid"), F.col("to").alias("root"))
        moved = stage(points.join(again, F.col("to") == F.col("mid")).select("node", "root"), "moved")
        if roots is None:
            roots = moved
        else:
            after = moved.select(F.col("node").alias("old"), F.col("root").alias("new"))
            roots = stage(
                roots.join(after, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "roots"
            )
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        shrunk = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = stage(shrunk.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        turn += 1
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

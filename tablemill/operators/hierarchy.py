"""Roll-ups over a parent/child table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import stage


def subtree_totals(tree: DataFrame) -> DataFrame:
    """Total of ``value`` and node count over each node's subtree; columns node, parent, value.

    By doubling: after round k every node knows the total over its descendants fewer than 2^k steps below,
    and the ancestor 2^k steps above.  A node hands its total to that ancestor and takes over the ancestor's
    own pointer, so the number of rounds is the logarithm of the depth.  A round is stored and holds at most
    one row per node; nodes whose pointer has left the tree take no further part in it.
    """
    kind = tree.schema["value"].dataType
    totals = stage(tree.select("node", F.col("value").alias("total"), F.lit(1).cast("long").alias("nodes")), "tree-totals")
    # a parent that is no node of the table has no row to hand to
    nodes = tree.select(F.col("node").alias("above"))
    pointers = stage(tree.select("node", F.col("parent").alias("above")).join(nodes, "above"), "tree-pointers")
    for _ in range(totals.count().bit_length() + 1):
        if pointers.isEmpty():
            return totals
        handed = pointers.join(totals, "node").groupBy(F.col("above").alias("node")).agg(
            F.sum("total").alias("__total"), F.sum("nodes").alias("__nodes"))
        more = totals.join(handed, "node", "left")
        plus = lambda own, new: F.when(new.isNull(), own).when(own.isNull(), new).otherwise(own + new)
        totals = stage(more.select("node", plus(F.col("total"), F.col("__total")).cast(kind).alias("total"),
                                   (F.col("nodes") + F.coalesce("__nodes", F.lit(0))).alias("nodes")), "tree-totals")
        farther = pointers.select(F.col("node").alias("above"), F.col("above").alias("next"))
        pointers = stage(pointers.join(farther, "above").select("node", F.col("next").alias("above")), "tree-pointers")
    raise ValueError("the parent links do not end; the table is not a tree")

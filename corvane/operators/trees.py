"""Trees from rows that name their parent: every node's root, depth and place, without a cap on depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import scratch


def assembled(nodes: DataFrame) -> DataFrame:
    """root, depth and place of every node (id, parent, sibling_order).

    A root has no parent. place lists (sibling_order, id) from below the root down to the node, so sorting by (root,
    place) is the order of a depth-first walk. Each node looks up to an ancestor and each round
    it takes that ancestor's ancestor instead, so what it looks up to is twice as far: rounds grow with the
    logarithm of the depth. Nodes of a circle, or below a parent that is not there, are in no tree and left out.
    """
    step = F.array(F.struct("sibling_order", "id"))
    held = nodes.select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.array().cast("array<struct<sibling_order:int,id:long>>")).otherwise(step).alias("place"))
    held = held.select("id", F.coalesce("up", "id").alias("up"), F.col("up").isNull().alias("done"), "place")
    held, size, rounds = scratch.kept(held), None, 0
    while True:
        open_ = held.where("NOT done")
        left = open_.count()
        # as many rounds as twice the logarithm of the nodes reach any root; what is open then goes round in a circle
        size = size if size is not None else held.count()
        if not left or rounds > size.bit_length():
            break
        above = held.select(F.col("id").alias("over"), F.col("up").alias("over_up"), F.col("done").alias("over_done"), F.col("place").alias("over_place"))
        jumped = open_.join(above, F.col("up") == F.col("over")).select("id", F.col("over_up").alias("up"), F.col("over_done").alias("done"), F.concat("over_place", "place").alias("place"))
        held, rounds = scratch.kept(held.where("done").unionAll(jumped)), rounds + 1
    return held.where("done").select("id", F.col("up").alias("root"), F.size("place").alias("depth"), "place")


def loose(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """id of the nodes that are in none of the :func:`assembled` trees."""
    return nodes.select("id").join(trees, "id", "left_anti")


def inconsistent(nodes: DataFrame) -> DataFrame:
    """blob and roots of the blobs whose nodes (blob, id, parent) have not just one root."""
    roots = nodes.groupBy("blob").agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("roots"))
    return roots.where("roots <> 1")

"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import discard, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node that a link (a, b) of longs names.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then
    its smaller ones (small star), until no link changes. The number of rounds grows with the
    logarithm of the longest path. Each round's links are a table in the shared folder, one row a
    link, so nothing but the count of changes comes to the driver. Links with a null end and
    self-links are ignored; repeated links count once; no links give no rows.
    """
    links = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ways = _both_ways(links)
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = ways.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            large.join(lower, "a")
            .select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("x"))
            .select("x.*")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        after = stored(small)
        same = after.join(links, ["a", "b"], "left_anti").isEmpty() and links.join(after, ["a", "b"], "left_anti").isEmpty()
        discard(links)
        links = after
        if same:
            break
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))

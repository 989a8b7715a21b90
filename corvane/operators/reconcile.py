"""Desired against actual: worktrees, messages, directories, polling and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def set_difference(desired: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key and action: add what is desired and absent, remove what is there and not desired."""
    add = desired.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("action", F.lit("add"))
    return add.unionByName(actual.select(key).distinct().join(desired.select(key), key, "left_anti").withColumn("action", F.lit("remove")))


def missed(sightings: DataFrame, key: str, order: str, seen: str, times: int = 2) -> DataFrame:
    """Keys that the last ``times`` passes in a row did not see."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    tail = sightings.withColumn("__n", F.row_number().over(last)).where(F.col("__n") <= times)
    return tail.groupBy(key).agg(F.count_if(~F.col(seen)).alias("n")).where(F.col("n") == times).select(key)


def sync_messages(desired: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """The notification table: what is desired, with the acknowledgement of a message that stays the same."""
    old = actual.select(key, F.col("text").alias("__text"), F.col("acked").alias("__acked"))
    same = F.col("text") == F.col("__text")
    return desired.join(old, key, "left").select(key, "text", F.coalesce(same & F.col("__acked"), F.lit(False)).alias("acked"))


def due(rows: DataFrame, last: str, now: int, every: int) -> DataFrame:
    """Rows never checked, or longer ago than ``every`` seconds."""
    return rows.where(F.coalesce(F.col(last) < now - every, F.lit(True)))


def topmost(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that lie below no other of them: each ancestor is an equality join."""
    parts = F.split(F.col(path), "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    wide = paths.select(path, F.explode(above).alias("__above"))
    covered = wide.join(paths.select(F.col(path).alias("__above")).distinct(), "__above", "left_semi").select(path)
    return paths.select(path).distinct().join(covered, path, "left_anti")


def poll_order(sessions: DataFrame, live: Column, known: Column) -> DataFrame:
    """Sessions in the order of polling: live ones, then new ones, then the backlog, newest first within each."""
    lane = F.when(live, 0).when(~known, 1).otherwise(2)
    return sessions.withColumn("lane", lane)


def nearest(points: DataFrame, marks: DataFrame, by: str, at: str) -> DataFrame:
    """Each point with the nearest mark of its key, the earlier one of two that are equally near."""
    l = points.select(by, F.col(at).alias("__at"), F.col("id").alias("id"), F.lit(None).cast("long").alias("m"))  # noqa: E741
    r = marks.select(by, F.col(at).alias("__at"), F.lit(None).cast("long").alias("id"), F.col(at).cast("long").alias("m"))
    every = Window.partitionBy(by).orderBy("__at")
    before = F.last("m", ignorenulls=True).over(every.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("m", ignorenulls=True).over(every.rangeBetween(0, Window.unboundedFollowing))
    found = l.unionByName(r).withColumns({"b": before, "a": after}).where("id IS NOT NULL")
    closer = F.when(F.col("b").isNull() | (F.col("a") - F.col("__at") < F.col("__at") - F.col("b")), F.col("a")).otherwise(F.col("b"))
    return found.select("id", closer.alias("mark"))


def ancestors(elements: DataFrame, depth: int = 20) -> DataFrame:
    """id, ancestor and distance up the parents, at most ``depth`` levels: one join a level, until none is left."""
    links = elements.where("parent_id IS NOT NULL").select("id", "parent_id")
    level = links.select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance"))
    found = level
    for n in range(2, depth + 1):
        level = level.join(links.select(F.col("id").alias("ancestor"), "parent_id"), "ancestor").select("id", F.col("parent_id").alias("ancestor"), F.lit(n).alias("distance"))
        if level.isEmpty():
            break
        found = found.unionAll(level)
    return found


def diagnosis(below_floor: Column, scope_rows: Column, path_rows: Column, hidden: Column) -> Column:
    """Why a page is empty: the first reason that holds."""
    return (
        F.when(scope_rows == 0, "scope_unmatched").when(path_rows == 0, "path_unmatched").when(below_floor > 0, "below_floor").when(hidden > 0, "retrieval_hidden").otherwise("no_match")
    )


def matched_clusters(old: DataFrame, new: DataFrame, least: float = 0.3) -> DataFrame:
    """old, new and jaccard of clusters (node, cluster) that overlap at ``least``; each cluster with its best counterpart only."""
    pairs = old.select("node", F.col("cluster").alias("old")).join(new.select("node", F.col("cluster").alias("new")), "node").groupBy("old", "new").agg(F.count("*").alias("n"))
    sizes = lambda df, name, size: df.groupBy(F.col("cluster").alias(name)).agg(F.count("*").alias(size))
    scored = pairs.join(sizes(old, "old", "no"), "old").join(sizes(new, "new", "nn"), "new").withColumn("jaccard", F.round(F.col("n") / (F.col("no") + F.col("nn") - F.col("n")), 6))
    best = lambda name, other: F.row_number().over(Window.partitionBy(name).orderBy(F.desc("jaccard"), other))
    return scored.where(F.col("jaccard") >= least).withColumns({"x": best("old", "new"), "y": best("new", "old")}).where("x = 1 AND y = 1").select("old", "new", "jaccard")

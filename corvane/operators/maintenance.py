"""Keeping the index right: missing work, superseded parses, garbage, upserts and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane import scratch


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row of ``wanted`` for each key that ``done`` lacks: the one with the smallest id."""
    rows = wanted.join(done.select(key), key, "left_anti")
    return rows.groupBy(key).agg(F.min("id").alias("id"))


def current_parses(parses: DataFrame, version: str, blob: str = "blob_sha", by: str = "parser_version") -> DataFrame:
    """Of each blob the current version's rows if it has any, else all."""
    has = F.max((F.col(by) == version).cast("int")).over(Window.partitionBy(blob))
    return parses.withColumn("__has", has).where((F.col(by) == version) | (F.col("__has") == 0)).drop("__has")


def superseded_parses(parses: DataFrame, version: str, blob: str = "blob_sha", by: str = "parser_version") -> DataFrame:
    """What :func:`current_parses` leaves out."""
    has = F.max((F.col(by) == version).cast("int")).over(Window.partitionBy(blob))
    return parses.withColumn("__has", has).where((F.col(by) != version) & (F.col("__has") == 1)).drop("__has")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both by key; of a key in both, or repeated, the one with the highest version."""
    every = old.unionByName(new)
    last = Window.partitionBy(*key).orderBy(F.desc(version))
    return every.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path", value: str = "blob_sha") -> DataFrame:
    """path and change: added, modified or removed."""
    a, b = before.select(F.col(key), F.col(value).alias("__a")), after.select(F.col(key), F.col(value).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where(F.col("change").isNotNull())


def collect_garbage(jobs: DataFrame, elements: DataFrame, summaries: DataFrame, vectors: DataFrame, live: DataFrame) -> DataFrame:
    """What is left and what can go, level by level; each level is judged by what the one before it keeps.

    ``live`` has the hashes that a path or a turn holds. An element lives by its blob, a summary
    by a living element's text, a vector by either, a job by a living element.
    """
    kept_elements = elements.join(live.select(F.col("blob_sha")).distinct(), "blob_sha", "left_semi")
    texts = scratch.kept(kept_elements.select("raw_hash").distinct())
    kept_summaries = summaries.join(texts, "raw_hash", "left_semi")
    sources = scratch.kept(texts.select(F.col("raw_hash").alias("source_hash")).union(kept_summaries.select("text_hash")).distinct())

    def judged(level: str, rows: DataFrame, key: str, by: DataFrame) -> DataFrame:
        return rows.select(key).join(by.select(key, F.lit(1).alias("kept")), key, "left").select(F.lit(level).alias("level"), "kept")

    levels = [judged("jobs", jobs, "raw_hash", texts), judged("elements", elements, "blob_sha", live.select("blob_sha").distinct()), judged("summaries", summaries, "raw_hash", texts), judged("vectors", vectors, "source_hash", sources)]
    counted = reduce(DataFrame.unionAll, levels).groupBy("level").agg(F.count("*").alias("total"), F.count("kept").alias("kept"))
    every = jobs.sparkSession.createDataFrame([(n,) for n in ("jobs", "elements", "summaries", "vectors")], "level string")  # a level without rows is one too
    out = every.join(counted, "level", "left").fillna(0, ["total", "kept"])
    return out.withColumn("freed", F.col("total") - F.col("kept"))


def wanted_jobs(jobs: DataFrame, raw: DataFrame, smart: DataFrame) -> DataFrame:
    """Jobs (id, payload) whose JSON payload names a living content: ``raw_hash`` among ``raw``, or the first entry of
    one of its ``items`` among ``raw`` or ``smart`` (hash each). A payload that names none, or is not JSON, is not wanted."""
    said = F.from_json("payload", "raw_hash string, items array<array<string>>")
    firsts = F.transform(said["items"], lambda x: F.struct(F.try_element_at(x, F.lit(1)).alias("hash"), F.lit(True).alias("item")))
    own = F.array(F.struct(said["raw_hash"].alias("hash"), F.lit(False).alias("item")))
    named = jobs.select("id", F.inline(F.concat(own, F.coalesce(firsts, F.array().cast("array<struct<hash:string,item:boolean>>"))))).where("hash IS NOT NULL")
    alive = raw.select("hash", F.lit(False).alias("only_items")).union(smart.select("hash", F.lit(True).alias("only_items"))).groupBy("hash").agg(F.bool_and("only_items").alias("only_items"))
    kept = named.join(alive, "hash").where("item OR NOT only_items").select("id").distinct()
    return jobs.join(kept, "id", "left_semi")


def tree_inconsistencies(elements: DataFrame, group: list[str], is_root: Column) -> DataFrame:
    """Groups that do not have exactly one root, with the roots' ids in order."""
    roots = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_root, F.col("id")))), lambda x: x.cast("string")), ",")
    return elements.groupBy(*group).agg(F.count_if(is_root).alias("roots"), roots.alias("ids")).where(F.col("roots") != 1)


def shared_hashes(turns: DataFrame, least: int, conversation: str = "conv_id", key: str = "raw_hash") -> DataFrame:
    """Texts that stand in at least ``least`` conversations."""
    return turns.groupBy(key).agg(F.count_distinct(conversation).alias("conversations"), F.count("*").alias("turns")).where(F.col("conversations") >= least)

"""Parsing that goes on where the last run ended: a blob is parsed once for each version of the parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.sources import snapshots

ELEMENTS, STATE = "elements", "state"


def plan(files: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """(path, blob_sha) with step: ``stored`` if this version has parsed the blob, ``parse`` for the first path of any other blob, ``reuse`` for its further paths."""
    known = state.where(F.col("parser_version") == version).select("blob_sha").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("blob_sha").orderBy("path")) == 1
    step = F.when(F.col("known"), "stored").when(first, "parse").otherwise("reuse")
    return files.select("path", "blob_sha").join(known, "blob_sha", "left").select("path", "blob_sha", step.alias("step"))


def unparsed(blobs: DataFrame, state: DataFrame, version: str) -> DataFrame:
    """Different blob_sha that no run of this version has parsed: what a rescan has to be asked for."""
    return blobs.select("blob_sha").distinct().join(state.where(F.col("parser_version") == version), "blob_sha", "left_anti")


def run(files: DataFrame, folder: str, name: str, version: str, parse: Callable[[DataFrame], DataFrame]) -> int:
    """Parse what is new of (path, blob_sha, text) and publish it with all before as snapshot ``name``; the number of blobs parsed.

    ``parse`` gets (blob_sha, text), one row a blob, and gives rows with blob_sha. A run with nothing new publishes nothing.
    """
    spark = files.sparkSession
    held = snapshots.current(spark, folder)
    empty = spark.createDataFrame([], "blob_sha string, parser_version string, run string")
    state = held[STATE] if held else empty
    wanted = unparsed(files, state, version)
    n = wanted.count()
    if not n:
        return 0
    texts = files.join(wanted, "blob_sha", "left_semi").groupBy("blob_sha").agg(F.any_value("text").alias("text"))  # equal hash, equal text
    fresh = parse(texts).withColumns({"parser_version": F.lit(version), "run": F.lit(name)})
    elements = held[ELEMENTS].unionByName(fresh) if held else fresh
    done = state.unionByName(wanted.withColumns({"parser_version": F.lit(version), "run": F.lit(name)}))
    snapshots.publish({ELEMENTS: elements, STATE: done}, folder, name)
    return n

"""Long rewrites in bounded passes, which a stored cursor lets go on after a stop."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane import scratch
from corvane.sources import snapshots

CURSOR = "cursor.json"


def cursor(spark: SparkSession, folder: str) -> dict | None:
    """number and last (the key's values) of the last pass that was finished; none before the first."""
    return snapshots.read_text(spark, folder, CURSOR, json.loads)


def _beyond(key: list[str], last: list) -> Column:
    """Whether a row's key comes after ``last``."""
    condition = F.lit(False)
    for c, v in reversed(list(zip(key, last, strict=True))):
        condition = (F.col(c) > v) | ((F.col(c) == v) & condition)
    return condition


def step(rows: DataFrame, key: list[str], size: int, rewrite: Callable[[DataFrame], DataFrame], folder: str) -> int:
    """One pass: the next ``size`` keys after the cursor, all rows of each; how many keys, 0 at the end.

    The pass is written under its number and the cursor moves on only afterwards. A pass that was killed before
    that is done again over what it wrote, so it leaves nothing twice. Keys and their order must not change between passes; rows
    with a null in the key belong to no pass.
    """
    spark = rows.sparkSession
    done = cursor(spark, folder)
    number = done["number"] + 1 if done else 1
    ahead = rows.dropna(subset=key)
    if done:
        ahead = ahead.where(_beyond(key, done["last"]))
    bounds = ahead.select(*key).distinct().orderBy(*key).limit(size)
    found: Row = bounds.agg(F.count("*").alias("n"), F.max(F.struct(*key)).alias("last")).first()
    if not found["n"]:
        return 0
    last = list(found["last"])
    part = ahead.where(~_beyond(key, last))
    rewrite(part).write.mode("overwrite").parquet(f"{folder}/pass={number:06d}")
    snapshots.replace_text(spark, folder, CURSOR, json.dumps({"number": number, "last": last}))
    return found["n"]


def _numbered(rows: DataFrame, key: list[str], size: int, first: int) -> DataFrame:
    """The keys of ``rows`` with the pass of each: ``size`` keys a pass, in their order, from the pass ``first`` on.

    Keys are sorted by ranges; what stands before a range is a sum over the ranges, so no task sorts or counts all.
    """
    ordered = scratch.kept(rows.select(*key).distinct().repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__n", F.monotonically_increasing_id()))
    parted = ordered.select(*key, F.shiftright("__n", 33).alias("__range"), F.col("__n").bitwiseAND((1 << 33) - 1).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = parted.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.floor((F.col("__before") + F.col("__n")) / size) + first
    return scratch.kept(parted.join(F.broadcast(starts), "__range").select(*key, place.cast("int").alias("pass")))


def run(rows: DataFrame, key: list[str], size: int, rewrite: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """All passes that are left, and then the rows that all passes wrote, with their pass.

    The first is a :func:`step`; of the others, whose keys are numbered once, twice as many as before are written at a time, each
    under its own number, so the rows are read as often as the logarithm of the passes. Each time the cursor moves on afterwards. ``rewrite``
    gets the rows of several passes at once, and its rows hold the key.
    """
    spark = rows.sparkSession
    if not step(rows, key, size, rewrite, folder):
        return written(spark, folder)
    done = cursor(spark, folder)
    left = rows.dropna(subset=key)
    numbered = _numbered(left.where(_beyond(key, done["last"])), key, size, done["number"] + 1)
    end, many = numbered.agg(F.max("pass")).first()[0] or done["number"], 1
    while done["number"] < end:
        number = min(end, done["number"] + many)
        last = list(numbered.where(F.col("pass") == number).agg(F.max(F.struct(*key)).alias("last")).first()["last"])
        part = left.where(_beyond(key, done["last"]) & ~_beyond(key, last))
        mine = numbered.where((F.col("pass") > done["number"]) & (F.col("pass") <= number))
        written_anew = rewrite(part)
        found = written_anew.join(mine, key).select(*written_anew.columns, F.format_string("%06d", "pass").alias("pass"))
        found.repartition("pass").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass").parquet(folder)
        done = {"number": number, "last": last}
        snapshots.replace_text(spark, folder, CURSOR, json.dumps(done))
        many *= 2
    return written(spark, folder)


def written(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of finished passes; what an unfinished one left is not read."""
    done = cursor(spark, folder)
    if not done:
        raise ValueError(f"no pass has been finished in {folder}")
    return spark.read.option("basePath", folder).option("pathGlobFilter", "*.parquet").parquet(folder).where(F.col("pass") <= done["number"])

"""A feed of events as JSON lines: a greeting, tagged events and heartbeats, each batch written once."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import snapshots

VERSION, NAME = 1, "corvane-events"
HEARTBEAT_SECONDS = 15
_LOG = "committed.json"


def lines(rows: DataFrame, kind: Column, at: str, fields: list[str]) -> DataFrame:
    """at and line of each row: ``{"v", "at", "kind", ...fields}``, the time in UTC with milliseconds; null fields are left out."""
    when = F.date_format(F.to_utc_timestamp(F.col(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    said = F.to_json(F.struct(F.lit(VERSION).alias("v"), when.alias("at"), kind.alias("kind"), *fields))
    return rows.select(F.col(at).alias("at"), said.alias("line"))


def heartbeats(spark: SparkSession, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """A stream of heartbeat lines, one every so many seconds."""
    beats = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", seconds * 1000).load()
    return lines(beats, F.lit("heartbeat"), "timestamp", [])


def greeting(heartbeat_seconds: int = HEARTBEAT_SECONDS) -> str:
    return json.dumps({"stream": NAME, "v": VERSION, "heartbeat_ms": heartbeat_seconds * 1000})


def _committed(spark: SparkSession, folder: str) -> list[int]:
    return snapshots.read_text(spark, folder, _LOG, json.loads) or []


def append(batch: DataFrame, number: int, folder: str) -> bool:
    """Write a batch of (at, line) in order of time; whether it was new. A batch that was committed before adds no line."""
    spark = batch.sparkSession
    done = _committed(spark, folder)
    if number in done:
        return False
    ordered = batch.repartitionByRange("at", "line").sortWithinPartitions("at", "line").select(F.col("line").alias("value"))
    ordered.write.mode("overwrite").text(f"{folder}/batch={number:09d}")
    snapshots.replace_text(spark, folder, _LOG, json.dumps(sorted([*done, number])))
    return True


def publish(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Write all that a stream of (at, line) holds now."""
    query = stream.writeStream.foreachBatch(lambda batch, n: append(batch, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """batch and line of the committed batches, the greeting first, as batch -1."""
    hello = spark.createDataFrame([(-1, greeting())], "batch int, line string")
    done = _committed(spark, folder)
    if not done:
        return hello
    found = spark.read.option("basePath", folder).text([f"{folder}/batch={n:09d}" for n in done])
    return hello.unionByName(found.select(F.col("batch").cast("int"), F.col("value").alias("line")))

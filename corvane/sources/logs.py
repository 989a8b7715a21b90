"""Conversation logs: records merged by message and resumed behind a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "session long, seq long, message string, role string, text string"


def parse(lines: DataFrame, schema: str = RECORD) -> DataFrame:
    """Records of JSON lines (value); lines that are blank or no record are dropped."""
    record = F.from_json(F.trim("value"), schema)
    return lines.select(record.alias("r")).where(F.col("r.seq").isNotNull()).select("r.*")


def merge_messages(records: DataFrame) -> DataFrame:
    """One row for each message: its parts in order, at the place of the first."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return records.groupBy("session", "message").agg(
        F.min("seq").alias("ordinal"), F.min_by("role", "seq").alias("role"), F.count("*").alias("parts"), F.array_join(parts, "\n").alias("body")
    )


def after(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """Records beyond each session's cursor; a session without one is read from its start."""
    joined = records.join(cursors.select("session", F.col("seq").alias("__c")), "session", "left")
    return joined.where(F.col("seq") > F.coalesce("__c", F.lit(-1))).drop("__c")


def cursors(records: DataFrame) -> DataFrame:
    return records.groupBy("session").agg(F.max("seq").alias("seq"))

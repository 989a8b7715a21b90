"""Turns: classes carried forward, idempotent appends, canonical text and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONVERSATION = "conv_id"


def classify(turns: DataFrame, calls: Column, retrieval: Column, breaks: Column) -> DataFrame:
    """Adds turn_class from flags of each turn.

    A turn with calls sets whether retrieval is pending; a turn of results alone keeps it; any
    other clears it. So the state before a turn is the last one set, carried over the results.
    """
    order = Window.partitionBy(CONVERSATION).orderBy("turn_no")
    state = F.when(calls, retrieval).when(breaks, F.lit(False))
    before = F.coalesce(F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    kind = (
        F.when(calls & retrieval, "retrieval_call")
        .when(calls, "tool_call")
        .when(~breaks & before, "retrieval_result")
        .when(~breaks, "tool_result")
        .otherwise("work")
    )
    return turns.withColumn("turn_class", kind)


def canonical_text(body: Column, items: Column) -> Column:
    """A turn as one text: its body, then each item (tool, text) under a heading of its own."""
    said = F.transform(items, lambda x: F.concat(F.lit("[tool-call "), x["tool"], F.lit("]\n"), x["text"]))
    return F.concat_ws("\n\n", F.regexp_replace(body, r"\s+$", ""), said)


def append(seen: DataFrame, records: DataFrame, key: list[str], turns: DataFrame) -> DataFrame:
    """Records that the ledger ``seen`` lacks, numbered on from each session's last turn; a replay adds none."""
    new = records.dropDuplicates([*key, "ordinal"]).join(seen.select(*key, "ordinal"), [*key, "ordinal"], "left_anti")
    last = turns.groupBy(*key).agg(F.max("turn_no").alias("__last"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("ordinal"))
    return new.join(last, key, "left").withColumn("turn_no", F.coalesce("__last", F.lit(0)) + number).drop("__last")


def window(turns: DataFrame, guid: object, around: int, before: int = 10, after: int = 20) -> DataFrame:
    """Turns around one of a conversation."""
    if not (0 <= before <= 200 and 0 <= after <= 200):
        raise ValueError("a window reaches at most 200 turns either way")
    return turns.where((F.col(CONVERSATION) == guid) & F.col("turn_no").between(around - before, around + after))


def dirty(heads: DataFrame, cached: DataFrame) -> DataFrame:
    """conv_id and change (new, grown, removed) from two tables of (conv_id, last_turn, n)."""
    a, b = cached.select(CONVERSATION, F.struct("last_turn", "n").alias("__a")), heads.select(CONVERSATION, F.struct("last_turn", "n").alias("__b"))
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "grown")
    return a.join(b, CONVERSATION, "full_outer").select(CONVERSATION, change.alias("change")).where("change IS NOT NULL")


def heads(turns: DataFrame) -> DataFrame:
    return turns.groupBy(CONVERSATION).agg(F.max("turn_no").alias("last_turn"), F.count("*").alias("n"))

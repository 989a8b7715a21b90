"""Exact deduplication by a distributed content sort (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading characters that the range splitters see. Splitters are sampled to the
#: driver, so they are short; ties are split by the hash and the salt after them.
SPLITTER_CHARS = 32
#: Parts into which the rows of one text are divided, so that no text fills one task.
SALTS = 64


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Column | None = None,
    keep: str = "max",
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are range-partitioned by sampled splitters over (leading characters, hash, salt),
    sorted externally by the whole normalised text, and runs of equal neighbours are found
    by a sort aggregate, which compares each text in full with the one before it. A run
    becomes one short row per (text, salt); its totals go back to the rows by (digest, salt).

    ``keep`` is ``"max"`` or ``"min"``: the identifier that stays. A null text counts as
    empty. Rows that repeat the kept identifier and text all count in group_size and are all
    kept. A null identifier is never kept unless its whole group has none, when keep_id is
    null and kept is false. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")) if normalise is None else F.coalesce(normalise, F.lit(""))
    best = F.max if keep == "max" else F.min
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    )
    keys = ["head", "hash", "body", "salt"]
    runs = (
        rows.withColumns({"head": F.substring("body", 1, SPLITTER_CHARS), "hash": F.xxhash64("body")})
        .repartitionByRange("head", "hash", "salt")
        .sortWithinPartitions(*keys)
        .groupBy(*keys)
        # a string in the buffer makes this a sort aggregate over the sorted runs
        .agg(F.max(F.lower(F.sha2("body", 256))).alias("text_sha256"), best("doc_id").alias("best"), F.count("*").alias("n"))
        .select("text_sha256", "salt", "best", "n")
    )
    same = Window.partitionBy("text_sha256")  # at most `salts` rows each
    totals = runs.select("text_sha256", "salt", best("best").over(same).alias("keep_id"), F.sum("n").over(same).alias("group_size"))
    marked = rows.select("doc_id", "salt", F.sha2("body", 256).alias("text_sha256"))
    return marked.join(totals, ["text_sha256", "salt"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` with one row for each distinct text, all columns unchanged.

    Follows :func:`exact_groups`. Identifiers are taken to be unique; a row whose identifier
    is null cannot be named, so it stays.
    """
    groups = exact_groups(docs, id_col, text_col, keep=keep)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")

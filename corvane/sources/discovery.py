"""Files of a directory tree with the verdict on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import LARGEST, LEAST, language_family, skip_reason

#: Directory names that are never entered. Fixed values.
PRUNED = ("node_modules", "target", "dist", "build", "vendor", "__pycache__", "venv")
#: Bytes at the start of a file that are looked at for a null byte.
SNIFFED = 8192


def hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.[^/.]")


def verdicts(files: DataFrame, include_hidden: bool = False, largest: int = LARGEST, least: int = LEAST) -> DataFrame:
    """Adds family, blob_sha and skip_reason to (path, length, content): the first rule that holds, null for a file to index."""
    family = language_family(F.col("path"))
    pruned = F.col("path").rlike(rf"(^|/)({'|'.join(PRUNED)})/")
    binary = F.instr(F.decode(F.substring("content", 1, SNIFFED), "ISO-8859-1"), "\0") > 0  # a character a byte
    reason = F.when(pruned, "pruned").when(~F.lit(include_hidden) & hidden(F.col("path")), "hidden").otherwise(
        F.coalesce(skip_reason(family, F.col("length"), largest, least), F.when(binary, "binary"))
    )
    return files.withColumns({"family": family, "blob_sha": F.sha2("content", 256), "skip_reason": reason})


def discover(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """path (below the root), length, family, blob_sha and skip_reason of every file of a tree.

    Spark's reader lists no empty files and no names that start with a dot or underscore; rows for
    those can come from another listing through :func:`verdicts`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace("path", rf"^(file:)?/*{root.strip('/')}/", "")
    return verdicts(files.select(below.alias("path"), "length", "content"), include_hidden).drop("content")


def skip_counts(found: DataFrame) -> DataFrame:
    return found.where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))

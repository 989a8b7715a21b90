"""Snapshots of tables: written whole, published at once, queried by SQL."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(tables: dict[str, DataFrame], folder: str, snapshot: str) -> str:
    """Write every table under a new snapshot, then name it in the manifest; readers see all of it or nothing."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", snapshot):
        raise ValueError("a snapshot's name has letters, digits, dots, dashes and underscores only")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.option("compression", "zstd").mode("errorifexists").parquet(f"{folder}/{snapshot}/{name}")
    replace_text(spark, folder, "manifest.json", json.dumps({"snapshot": snapshot, "tables": sorted(tables)}))
    return f"{folder}/{snapshot}"


def replace_text(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file whole: it is written beside and takes the old one's place at once, so that no reader finds it half written."""
    jvm = spark._jvm
    target, beside = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (name, f".{name}.{uuid.uuid4().hex}"))
    conf = spark._jsc.hadoopConfiguration()
    out = target.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, how)


def read_text(spark: SparkSession, folder: str, name: str, parse: Callable[[str], object]) -> object | None:
    """What ``parse`` makes of a small file; none where there is no such file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return parse(spark.read.text(f"{folder}/{name}", wholetext=True).first()[0])


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the snapshot that the manifest names; none before the first was published."""
    found = read_text(spark, folder, "manifest.json", json.loads) or {"tables": []}
    return {name: spark.read.parquet(f"{folder}/{found['snapshot']}/{name}") for name in found["tables"]}


def ask(tables: dict[str, DataFrame], sql: str, most: int) -> DataFrame:
    """Rows of SQL over the tables as views, ``most`` at best, with whether there were more."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    rows = spark.sql(sql).limit(most + 1)
    more = rows.agg((F.count("*") > most).alias("truncated"))
    return rows.limit(most).crossJoin(F.broadcast(more))  # one row


def dictionary(tables: dict[str, DataFrame]) -> DataFrame:
    """name, columns and rows of each table."""
    out = None
    for name, df in sorted(tables.items()):
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), F.lit(",".join(sorted(df.columns))).alias("columns"), "rows")
        out = row if out is None else out.unionAll(row)
    return out


def encoded(df: DataFrame, column: str) -> DataFrame:
    """Adds column_no: the place of each value among the distinct ones, from 0, by a small table rather than one sort of all rows."""
    from pyspark.sql.window import Window

    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = values.withColumn(f"{column}_no", F.row_number().over(Window.orderBy(column)) - 1)  # one row a distinct value
    return df.join(numbered, column, "left")

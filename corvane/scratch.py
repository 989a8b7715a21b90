"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset and all of Spark is on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to such a folder and read back: a lost executor costs a re-read, and plans do not grow."""
    path, schema = folder(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


_ONCE: dict[tuple[str, str], object] = {}


def once(spark: SparkSession, name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave the first time it was asked for under this name in the application: indexes are built once and then opened."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]

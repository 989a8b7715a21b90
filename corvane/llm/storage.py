"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from corvane import scratch

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local one only where that is unset and all of Spark is on this machine."""
    return scratch.folder(spark)


def stored(df: DataFrame, batch_rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. Nothing needs
    the step's shuffle files any more; Spark deletes them once the driver's heap is collected,
    so that is asked for here. ``batch_rows`` is for steps in Python with large rows: so many
    of them, instead of the session's number, make an Arrow batch.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    schema = df.schema
    usual = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, batch_rows)
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    del df
    gc.collect()  # the driver's Python holds the heap's objects
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`stored`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

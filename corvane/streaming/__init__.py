"""Streams: tails of append-only logs, the ledger of seen records, and settled bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tail(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.jsonl", most_files: int = 1000) -> DataFrame:
    """Records of a folder of JSON-lines files as they come; blank and torn lines are dropped, offsets are the checkpoint's."""
    lines = spark.readStream.option("pathGlobFilter", glob).option("maxFilesPerTrigger", most_files).text(folder)
    record = F.from_json(F.trim("value"), schema)
    return lines.where(F.trim("value") != "").select(record.alias("r")).where(F.col("r").isNotNull()).select("r.*")


def unseen(records: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Each record once: a replay within ``late`` of the newest time adds nothing, and the ledger's state is dropped after it."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def record(stream: DataFrame, key: list[str], path: str, checkpoint: str) -> None:
    """Write each record of a stream once, for good: the rows written before are the ledger, and a replay adds nothing however late it comes.

    A batch is compared with the keys of all other batches, and a retried batch takes the place of what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        others = [f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName() != f"batch={number}"] if fs.exists(folder) else []
        once = batch.dropDuplicates(key)
        if others:
            once = once.join(spark.read.schema(batch.schema).parquet(*others).select(*key), key, "left_anti")
        once.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def bursts(events: DataFrame, key: str, time: str, quiet: str, late: str = "10 minutes") -> DataFrame:
    """Bursts of each key's events that a gap of ``quiet`` ends; the streaming twin of ``operators.queue.debounce``."""
    window = F.session_window(time, quiet)
    return (
        events.withWatermark(time, late)
        .groupBy(key, window.alias("w"))
        .agg(F.count("*").alias("n"), F.max(time).alias("last"))
        .select(key, F.col("w.start").alias("first"), "last", F.col("w.end").alias("settled"), "n")
    )


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all there is now, as Parquet; each batch is written under its number, so that a retry overwrites it.

    In complete mode a batch is the whole state, so it takes the place of those before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if mode == "complete":
            spark = batch.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            for found in fs.listStatus(folder):
                if found.getPath().getName() != f"batch={number}":
                    fs.delete(found.getPath(), True)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

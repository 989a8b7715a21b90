"""Token ids as Parquet list columns with dictionary encoding, small pages and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.tokens import default_vocabulary, encoded
from corvane.llm.windows import one_by_one

#: Writer settings. Format version 2 gives the integer columns that outgrow a dictionary
#: delta encoding; small pages and row groups let a reader of some documents, or of the
#: lengths alone, skip the rest through the page index, which Parquet writes by default.
FORMAT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
}
#: Tokens in an Arrow batch that a worker hands over.
BATCH_TOKENS = 250_000
_FILE_COLUMNS = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.list_(pa.int32()))])


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text and write the ids in ascending identifier order.

    The files, in name order, hold the documents in order of (identifier, text): sampled
    splitters range-partition the identifiers and each partition becomes one file, with the
    columns doc_id, part (the file's place), part_start (ids before the document in its file),
    n_tokens and ids (with the end id). A null text counts as empty, a null identifier sorts
    first, repeated rows are all written, an empty table gives no rows. Other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        rows = (pair for b in batches for pair in one_by_one(b))
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            lengths = [len(ids) // 4 for _, _, ids in held]
            ids = pa.array(np.frombuffer(b"".join(x for _, _, x in held), dtype="<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            columns = [[k for k, _, _ in held], [part] * len(held), [s for _, s, _ in held], lengths]
            arrays = [pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=False)]
            return pa.record_batch([*arrays, pa.ListArray.from_arrays(offsets, ids)], schema=_ARROW)

        for key, ids in encoded(rows, vocabulary, end_id):
            held.append((key, start, ids))
            start += len(ids) // 4
            size += len(ids) // 4
            if size >= BATCH_TOKENS:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(encode, _FILE_COLUMNS)
        .write.options(**FORMAT)
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows as they are; filters on doc_id reach the page index."""
    return spark.read.schema(_FILE_COLUMNS).parquet(path)


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Add start, the ids of all earlier documents, to rows that have part and part_start.

    Only the lengths are read for it, and only one row a file meets in one task.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = read_token_files(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of the documents that ``where`` (on doc_id or n_tokens) selects."""
    rows = read_token_files(spark, path)
    rows = rows if where is None else rows.where(where)
    return with_starts(spark, path, rows).select("doc_id", "start", F.col("n_tokens").cast("long"), "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    out = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.record_batch([b.column("doc_id"), b.column("part"), b.column("part_start"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())], schema=out)

    rows = read_token_files(spark, path).mapInArrow(digest, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")

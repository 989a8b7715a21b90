"""SimHash near-duplicates: pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.storage import stored

#: Words of a shingle, and the seed of its hash.
SHINGLE, SEED = 3, 42
#: Differing bits up to which two fingerprints link.
DISTANCE = 3
#: Blocks of a fingerprint. Of 6 blocks, 3 or fewer differing bits leave 3 equal, so there are
#: 20 keys of about 32 bits, and unrelated fingerprints seldom meet up to billions of them.
BLOCKS = 6
#: Fingerprints of one key that a worker compares at once; a larger group is split by finer blocks.
GROUP = 4096
#: Blocks of a large group: 13 of 16 blocks of 4 bits equal leave 12 free bits, so at most 4096 values.
FINE_BLOCKS = 16


def fingerprint(text: str | None) -> int:
    """64 bits: each is 1 where more than half of the shingles' hashes have it; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, blanks 0x20 and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths).tolist()
    ends = stops[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and bits (the fingerprint as a signed long) of every whole text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(b.column(1)[i].as_py()) for i in range(b.num_rows)], "<u8").view("<i8")
            yield pa.record_batch([b.column(0), pa.array(bits)], names=["doc_id", "bits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(compute, "doc_id long, bits long")


def _masks(bits: list[int], blocks: int, equal: int) -> list[int]:
    """Signed masks that keep every choice of ``equal`` blocks of the given bit numbers."""
    parts = [sum(1 << b for b in p.tolist()) for p in np.array_split(bits, blocks)]
    masks = [sum(c) for c in combinations(parts, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(prints: DataFrame, blocks: int, distance: int) -> DataFrame:
    """bits under each of its keys; any two within the distance share one."""
    masks = _masks(list(range(64)), blocks, blocks - distance)
    keys = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(masks)]), lambda x: F.xxhash64(x["i"], F.col("bits").bitwiseAND(x["m"])))
    return prints.select(F.explode(keys).alias("key"), "bits")


def _compare(distance: int, most: int | None):
    """For rows sorted by key: links (a, b) that span each key's groups; the rows of a group of more than ``most`` come back as (key, bits) with large set."""

    def spanned(values: np.ndarray) -> Iterator[tuple[int, int]]:
        left = np.unique(values)
        while len(left) > 1:
            root, left = left[0], left[1:]
            front = [root]
            while front and len(left):
                near = np.bitwise_count(left ^ front.pop()) <= distance
                found, left = left[near], left[~near]
                yield from ((root, x) for x in found)
                front.extend(found)

    def emit(rows: list[tuple[int, int]], large: bool) -> pa.RecordBatch:
        pairs = np.array(rows, "<u8").reshape(-1, 2).view("<i8")
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([large] * len(pairs))], names=["a", "b", "large"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, wide = None, [], 0, False

        def close() -> list[tuple[int, int]]:
            if wide or size < 2:
                return []
            return list(spanned(np.concatenate(held)))

        for b in batches:
            keys = b.column(0).to_numpy()
            values = b.column(1).to_numpy().view("<u8")
            cuts = np.flatnonzero(np.diff(keys)) + 1
            out: list[tuple[int, int]] = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if i == j:
                    continue
                if keys[i] != key:
                    out += close()
                    key, held, size, wide = keys[i], [], 0, False
                held.append(values[i:j])
                size += j - i
                if most is not None and size > most:
                    wide = True
                if wide:
                    mine = np.concatenate(held)
                    held = []
                    yield emit([(np.uint64(np.int64(key).view(np.uint64)), x) for x in mine], True)
            if out:
                yield emit(out, False)
        if out := close():
            yield emit(out, False)

    return compare


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) of different fingerprints that connect all that lie within the distance.

    Each key's fingerprints are compared in one worker, which gives back links that span the
    groups it finds rather than all pairs. A key with more than ``GROUP`` fingerprints is keyed
    again by finer blocks, whose groups cannot be larger than their free bits allow.
    """
    columns = "a long, b long, large boolean"
    first = stored(_keyed(prints, BLOCKS, distance).repartition("key").sortWithinPartitions("key").mapInArrow(_compare(distance, GROUP), columns))
    found = first.where(~F.col("large")).select("a", "b")
    large = first.where("large").select(F.col("b").alias("bits")).distinct()
    if large.isEmpty():
        return found
    # any two of a large key share it, but a finer key alone already holds every pair within the distance
    fine = _keyed(large, FINE_BLOCKS, distance).repartition("key").sortWithinPartitions("key").mapInArrow(_compare(distance, None), columns)
    return found.unionAll(fine.select("a", "b"))


def hexadecimal(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def simhash_groups(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits) and component_id.

    Texts are lower-cased (A-Z), split at blanks and shingled by three words, the whole sequence
    where there are fewer; equal fingerprints count once before they are compared. component_id is
    the smallest doc_id reachable over links of at most ``distance`` bits, the row's own included.
    A text that is null or has no word has fingerprint zero and is linked like any other. Null
    identifiers are no component_id unless a component has no other; repeated rows each appear; an
    empty table gives no rows. Other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col))
    prints = rows.groupBy("bits").agg(F.min("doc_id").alias("first"))
    group = components(links(prints, distance))
    named = prints.join(group, prints["bits"] == group["node"], "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = stored(named.join(smallest, "component").select("bits", "component_id"))
    return rows.join(answer, "bits").select("doc_id", hexadecimal("bits").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest identifier of each group; all columns unchanged. A row with a null identifier stays."""
    groups = simhash_groups(docs, distance, id_col, text_col)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")

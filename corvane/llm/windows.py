"""Windows of fixed length that also start in an earlier document, found by their hashes.

Documents are read in blocks. A block settles what it can by itself and sends the rest of its
window hashes, packed by hash range, to the task that holds that range of the reference; the
answers come back packed by block. Nothing is sent as a row per window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import stored

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 6 << 20
#: Windows that one range of hashes holds about, which bounds what a worker sorts at once.
RANGE_WINDOWS = 1_500_000
#: Rows in an Arrow batch; a block's windows of one range are a row of up to some hundred kilobytes.
BATCH_ROWS = 100
#: Bytes that are sent of a hash that only groups what second hashes tell apart.
GROUP_BYTES = 5
#: The identifier that stands for null: before all others.
NULL_ID = -(1 << 63)

# Fixed parameters of the rolling hash: an odd base and a random value for each byte.
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, of which only one is a Python object at a time: they may be large."""
    columns = batch.columns
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:  # doubling: the next stretch is this one times base ** done
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done, step = done + take, step * step % (1 << 64)
    return out


class Hashes:
    """64-bit hashes of byte ranges of an array, equal for equal bytes wherever they stand."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        if len(Hashes._up) < n:  # powers are kept for the worker's next arrays
            Hashes._up, Hashes._down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        self._sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUES[data] * Hashes._up[: n - 1], out=self._sums[1:])

    def ranges(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return self._mixed((self._sums[stops] - self._sums[starts]) * Hashes._down[starts], (stops - starts).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of all ranges of a width, by their start."""
        n = len(self._sums) - width
        return self._mixed((self._sums[width:] - self._sums[:n]) * Hashes._down[:n], np.array([width], np.uint64))

    @staticmethod
    def _mixed(h: np.ndarray, width: np.ndarray) -> np.ndarray:
        h ^= width * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def _press(values: np.ndarray) -> bytes:
    """Ascending integers as compressed differences."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    small = len(gaps) and gaps.min() >= 0 and gaps.max() < 1 << 16
    return (b"s" if small else b"l") + zstandard.ZstdCompressor(1).compress(gaps.astype("<u2" if small else "<i8").tobytes())


def _unpress(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), "<u2" if data[:1] == b"s" else "<i8")
    return np.cumsum(gaps, dtype=np.int64)


def _later(hashes: np.ndarray, ids: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Whether each hash, with the second one if given, also stands at a smaller identifier."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    new = sorted_[1:] != sorted_[:-1]
    if second is not None:  # should hashes of different ones be equal and interleave, more of them are taken for new
        new |= second[order][1:] != second[order][:-1]
    first = np.flatnonzero(np.append(True, new)) if len(order) else np.empty(0, np.int64)
    least = np.minimum.reduceat(ids[order], first) if len(order) else ids
    out = np.empty(len(hashes), bool)
    out[order] = ids[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    return out


_SENT = "bucket int, block long, ids binary, keys binary, bounds binary, places binary, codes binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64())] + [(c, pa.binary()) for c in ("ids", "keys", "bounds", "places", "codes")])
_TOLD = "block long, keys binary, bounds binary, kind int, places binary"
#: Kinds of answer: a place whose window starts earlier too, and one that must be looked at window by window.
LATER, CHECK = 0, 1


class Windows(NamedTuple):
    """The windows of a batch of documents that are to be looked up."""

    counts: np.ndarray  #: places of each document, whether looked up or not
    settled: np.ndarray  #: places known to start earlier, over all documents in turn
    open: np.ndarray  #: places to look up, likewise
    codes: np.ndarray  #: their hashes
    parts: np.ndarray | None = None  #: second hashes, compared only among equal first ones
    second: np.ndarray | None = None  #: independent hashes that choose the range, and so tell as many more windows apart as there are ranges


Hasher = Callable[[list[tuple]], Windows]


def _sent(number: int, ids: list[int], keys: list[int], found: Windows, ranges: int, width: int) -> pa.RecordBatch:
    bounds = np.concatenate([[0], np.cumsum(found.counts)]).astype(np.int64)
    owners = np.array(ids)[np.searchsorted(bounds, found.open, side="right") - 1] if len(found.open) else np.empty(0, np.int64)
    here = _later(found.codes, owners, found.second if found.parts is None else found.parts)  # settled within the block
    settled = np.sort(np.concatenate([found.settled, found.open[here]]))
    pressed = _press(np.array(ids)), _press(bounds)
    # a negative bucket: the block itself, with the places that are settled already
    rows = [(-1 - number % 0x3FFFFFFF, number, pressed[0], _press(np.array(keys)), pressed[1], _press(settled), b"")]
    places, codes = found.open[~here], found.codes[~here]
    dealt = codes if found.second is None else found.second[~here]
    bucket = ((dealt >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(ranges + 1))
    parts = [] if found.parts is None else [_bytes(found.parts[~here], 8)]  # whole: equal parts settle windows unseen
    packed = np.concatenate([_bytes(codes, width), *parts], axis=1)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        mine = order[cuts[k] : cuts[k + 1]]
        rows.append((k, number, pressed[0], b"", pressed[1], _press(places[mine]), packed[mine].tobytes()))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT_ARROW, strict=True)], schema=_SENT_ARROW)


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _integers(packed: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8").ravel()


def send(docs: DataFrame, hasher: Hasher, ranges: int, width: int = 8) -> DataFrame:
    """Blocks of ``docs`` (doc_id, key, text and whatever else the hasher takes) with their windows by range of hashes, of which ``width`` bytes are sent."""

    def sender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, keys, rows, size = [], [], [], 0
        for b in batches:
            for doc, key, text, *more in one_by_one(b):
                ids.append(NULL_ID if doc is None else doc)
                keys.append(key)
                rows.append(((text or "").encode("utf-8", "surrogatepass"), *more))
                size += len(rows[-1][0])
                if size >= BLOCK_BYTES:
                    yield _sent(number, ids, keys, hasher(rows), ranges, width)
                    number, ids, keys, rows, size = number + 1, [], [], [], 0
        if ids:
            yield _sent(number, ids, keys, hasher(rows), ranges, width)

    return docs.mapInArrow(sender, _SENT)


def _by_code(codes: np.ndarray, parts: np.ndarray | None, ids: np.ndarray) -> list[np.ndarray]:
    """Which entries are later, and which to check: the first of their part, where other parts share the code."""
    if parts is None:
        return [_later(codes, ids)]
    order = np.lexsort((ids, parts, codes))
    c, p, d = codes[order], parts[order], ids[order]
    new_code = np.append(True, c[1:] != c[:-1])
    new_part = new_code | np.append(True, p[1:] != p[:-1])
    least = d[np.flatnonzero(new_part)][np.cumsum(new_part) - 1]
    several = np.add.reduceat(new_part.astype(np.int64), np.flatnonzero(new_code))[np.cumsum(new_code) - 1] > 1
    later, check = np.empty(len(c), bool), np.empty(len(c), bool)
    later[order], check[order] = d > least, (d == least) & several
    return [later, check]


def answer(sent: DataFrame, ranges: int, width: int = 8) -> DataFrame:
    """The blocks themselves, and of each range the places of every block that are LATER or to CHECK."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["block", "keys", "bounds", "kind", "places"])

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        blocks, at, codes, parts, ids = [], [], [], [], []
        for block, table, bounds, places, packed in rows:
            blocks.append(block)
            at.append(_unpress(places))
            bytes_ = np.frombuffer(packed, np.uint8).reshape(len(at[-1]), -1)
            codes.append(_integers(bytes_[:, :width]))
            parts.append(_integers(bytes_[:, width:]) if bytes_.shape[1] > width else None)
            ids.append(_unpress(table)[np.searchsorted(_unpress(bounds), at[-1], side="right") - 1])
        two = parts[0] is not None
        found = _by_code(np.concatenate(codes), np.concatenate(parts) if two else None, np.concatenate(ids))
        cuts = np.cumsum([0, *map(len, at)]).tolist()
        hits = [(block, None, None, kind, at[n][mask[cuts[n] : cuts[n + 1]]]) for kind, mask in enumerate(found) for n, block in enumerate(blocks)]
        return told([(*h[:4], _press(h[4])) for h in hits if len(h[4])])

    def answerer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for bucket, block, ids, keys, *row in one_by_one(b):
                if bucket < 0:
                    yield told([(block, keys, row[0], LATER, row[1])])
                    continue
                if bucket != now and rows:
                    yield solve(rows)
                    rows = []
                now = bucket
                rows.append((block, ids, *row))
        if rows:
            yield solve(rows)

    # as many partitions as ranges, so that a task's share does not grow with the input
    return sent.repartition(ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(answerer, _TOLD)


def _by_document(told: DataFrame, ranges: int, make: Callable[[list[np.ndarray]], list[list[int]]], columns: list[str]) -> DataFrame:
    """key and what ``make`` gives for each document that has places; it gets their places of each kind, from 0 on."""

    def documents(keys: bytes, bounds: bytes, places: dict[int, list[bytes]]) -> pa.RecordBatch:
        names, ends = _unpress(keys), _unpress(bounds)
        at = [np.unique(np.concatenate([_unpress(p) for p in places[k]])) if places[k] else np.empty(0, np.int64) for k in (LATER, CHECK)]
        owner = [np.searchsorted(ends, x, side="right") - 1 for x in at]
        rows = []
        for d in np.unique(np.concatenate(owner)).tolist():
            mine = [x[slice(*np.searchsorted(o, [d, d + 1]))] - ends[d] for x, o in zip(at, owner, strict=True)]
            rows.append((int(names[d]), *make(mine)))
        types = [pa.int64()] + [pa.list_(pa.int32())] * len(columns)
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", *columns])

    def collector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, places = None, None, {LATER: [], CHECK: []}
        for b in batches:
            for block, keys, bounds, kind, held in one_by_one(b):
                if block != now:
                    if table is not None:
                        yield documents(*table, places)
                    now, table, places = block, None, {LATER: [], CHECK: []}
                if keys is not None:
                    table = (keys, bounds)
                places[kind].append(held)
        if table is not None:
            yield documents(*table, places)

    schema = ", ".join(["key long", *(f"{c} array<int>" for c in columns)])
    # the answers are small but take long to unpack, so their number of partitions is not left to their size
    found = told.repartition(ranges, "block").sortWithinPartitions("block").mapInArrow(collector, schema)
    return stored(found.groupBy("key").agg(*[F.first(c).alias(c) for c in columns]), batch_rows=BATCH_ROWS)


def ranges_for(windows: int) -> int:
    return max(8, -(-windows // RANGE_WINDOWS))


def repeated_spans(docs: DataFrame, hasher: Hasher, window: int, windows: int) -> DataFrame:
    """key and spans (start and stop in turn) of the units covered by windows that also start in an earlier document.

    ``docs`` has doc_id, key and text; rows of one key have the same text and identifier, and get
    one answer. Keys without such windows are absent. ``windows`` says about how many are sent.
    """

    def spans(places: list[np.ndarray]) -> list[list[int]]:
        at = places[LATER]
        breaks = np.flatnonzero(np.diff(at) > window)
        starts, stops = at[np.append(0, breaks + 1)], at[np.append(breaks, len(at) - 1)] + window
        return [np.column_stack([starts, stops]).ravel().tolist()]

    ranges = ranges_for(windows)
    return _by_document(answer(send(docs, hasher, ranges), ranges), ranges, spans, ["spans"])


def sorted_places(docs: DataFrame, hasher: Hasher, windows: int) -> DataFrame:
    """key, later and check: the places of each document by kind, for a hasher with parts."""
    ranges = ranges_for(3 * windows)  # two hashes each, and sorted by both
    return _by_document(answer(send(docs, hasher, ranges, GROUP_BYTES), ranges, GROUP_BYTES), ranges, lambda places: [p.tolist() for p in places], ["later", "check"])

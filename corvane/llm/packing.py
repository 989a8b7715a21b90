"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import default_vocabulary, encoded
from corvane.llm.windows import one_by_one

#: Context sizes, each a power of two; the largest is the longest sequence.
TIERS = (512, 1024, 2048, 4096)
#: Tokens packed together; what is left of a block goes on to the next one.
BLOCK_TOKENS = 1_000_000
#: Tokens of a step group: as many sequences of one tier as fill it.
STEP_TOKENS = 8 * 4096
#: Sequence and step numbers count from the task's number times this.
TASK_STRIDE = 1 << 33

Piece = tuple[object, int, bytes, int]  # doc_id, start, ids as bytes, the document's tokens


def _tokens(piece: Piece) -> int:
    return len(piece[2]) // 4


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


class Packer:
    """Packs the documents of one task.

    A document's whole windows of the largest size become sequences of their own. What is
    left of it is routed to the smallest tier that holds it. Tiers are packed from the largest
    down: the longest piece opens a window, the gap is filled with the longest pieces of any
    tier that fit, and where none fits a piece is cut to the gap. So every window is full; the
    last tokens of a task, under one window, are cut at powers of two.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.pool: list[tuple[int, int, Piece]] = []  # by length, then arrival
        self.size = 0
        self._arrived = 0

    def _keep(self, piece: Piece) -> None:
        self._arrived += 1
        bisect.insort(self.pool, (_tokens(piece), self._arrived, piece))
        self.size += _tokens(piece)

    def _take(self, i: int) -> Piece:
        n, _, piece = self.pool.pop(i)
        self.size -= n
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        top = self.tiers[-1]
        while _tokens(piece) >= top:
            window, piece = _cut(piece, top)
            yield [window]
        if _tokens(piece):
            self._keep(piece)

    def windows(self) -> Iterator[list[Piece]]:
        """Full windows of what has been routed; under one window of the first piece's tier is left."""
        while self.pool:
            tier = next(t for t in self.tiers if t >= self.pool[-1][0])
            if self.size < tier:
                return
            window, gap = [], tier
            while gap:
                i = bisect.bisect_right(self.pool, gap, key=lambda x: x[0]) - 1
                if i >= 0:
                    piece = self._take(i)
                else:
                    piece, rest = _cut(self._take(0), gap)
                    self._keep(rest)
                window.append(piece)
                gap -= _tokens(piece)
            yield window

    def tail(self) -> Iterator[list[Piece]]:
        """Sequences of powers of two for what windows() left."""
        while self.pool:
            gap, window = 1 << (self.size.bit_length() - 1), []
            while gap:
                piece = self._take(-1)
                if _tokens(piece) > gap:
                    piece, rest = _cut(piece, gap)
                    self._keep(rest)
                window.append(piece)
                gap -= _tokens(piece)
            yield window


_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens int, step_id long"


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each piece of a document: where its ids lie in the document and in a sequence.

    Each task packs the documents it reads, without a shuffle, holding about
    ``BLOCK_TOKENS`` ids at a time. Sequences of one tier are grouped into steps of
    ``step_tokens`` tokens; a task's last step may be shorter. Sequences whose length is a
    power of two, which here are all, need no padding. ``with_ids`` adds the ids themselves.

    A null text counts as empty, so the document is its end id alone; identifiers are carried
    as they are, null or repeated; an empty table gives no rows. Other columns are not read.
    """
    vocabulary = vocabulary or default_vocabulary()
    fields = [(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in _COLUMNS.split(", ")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * TASK_STRIDE
        packer, rows, n_sequences, n_steps = Packer(tiers), [], 0, 0
        steps: dict[int, list[int]] = defaultdict(lambda: [-1, step_tokens])  # by tier: step, tokens in it

        def place(window: list[Piece], tier: int | None = None) -> None:
            nonlocal n_sequences, n_steps
            total = sum(map(_tokens, window))
            step = steps[tier or total]
            if step[1] + total > step_tokens:
                step[:] = [n_steps, 0]
                n_steps += 1
            step[1] += total
            offset = 0
            for doc, start, ids, doc_tokens in window:
                n = len(ids) // 4
                row = (doc, start, n, zlib.crc32(ids), doc_tokens, first + n_sequences, offset, total, first + step[0])
                rows.append(row + (memoryview(ids).cast("i").tolist(),) if with_ids else row)
                offset += n
            n_sequences += 1

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            rows.clear()
            return made

        pairs = (pair for b in batches for pair in one_by_one(b))
        for key, ids in encoded(pairs, vocabulary, end_id):
            for window in packer.add((key, 0, ids, len(ids) // 4)):
                place(window)
            if packer.size >= BLOCK_TOKENS:
                for window in packer.windows():
                    place(window)
            if len(rows) >= 10_000:
                yield batch()
        for window in packer.windows():
            place(window)
        for window in packer.tail():
            place(window, -1)
        if rows:
            yield batch()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(pack_task, _COLUMNS + ", ids array<int>" * with_ids)

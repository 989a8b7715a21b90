"""Byte-level duplicate substrings across documents.

The windows of 50 bytes are classed by induction from a sample of positions, not one by one.
Every window holds an anchor, the 24 bytes in it with the smallest hash; the windows of one anchor
are neighbours and together read one phrase. Where a phrase stands in an earlier document, all its
windows do. Only where one anchor stands in different phrases are their windows looked at singly,
and only those of each phrase's first document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.windows import Hashes, Windows, one_by_one, repeated_spans, sorted_places

#: Bytes of a duplicate string, and of an anchor in it.
STRING, ANCHOR = 50, 24
#: Bytes of text whose hashes are held at a time.
STRETCH = 1 << 18
#: Anchors as a share of bytes, about, and windows to look at singly.
_ANCHORS_IN, _SINGLY_IN = 13, 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window, given less than 2**24 hashes of anchors."""
    # the place in the low bits: of equal anchors in a window the first counts
    least = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    span, n, done = STRING - ANCHOR + 1, len(hashes) - STRING + ANCHOR, 1
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    least = np.minimum(least[:n], least[span - done : span - done + n])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


class Phrases:
    """First and last window, anchor and document of each phrase of the documents that end at ``ends`` in an array of bytes."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        n, lengths = max(0, len(data) - STRING + 1), np.diff(ends, prepend=0)
        self.hashes, self.ends, self.starts = Hashes(data), ends, ends - lengths
        self.first = self.last = self.anchor = self.doc = np.empty(0, np.int64)
        if not n:
            return
        self.small = self.hashes.every(ANCHOR)
        reach = STRETCH + STRING - ANCHOR
        anchor = np.concatenate([i + _anchors(self.small[i : i + reach]) for i in range(0, n, STRETCH)])
        doc = np.repeat(np.arange(len(ends)), lengths)[:n]
        whole = np.repeat(ends, lengths)[:n] >= np.arange(STRING, n + STRING)
        change = np.empty(n, bool)
        change[0] = True
        np.logical_or(anchor[1:] != anchor[:-1], doc[1:] != doc[:-1], out=change[1:])
        # a document's windows stand together, so a phrase ends where the next begins or its document has no more
        self.first = np.flatnonzero(whole & change)
        self.doc, self.anchor = doc[self.first], anchor[self.first]
        closing = np.append(self.doc[1:] != self.doc[:-1], True) if len(self.first) else np.empty(0, bool)
        self.last = np.append(self.first[1:] - 1, 0)[: len(self.first)]
        self.last[closing] = ends[self.doc[closing]] - STRING


def _stretches(texts: list[bytes]) -> Iterator[list[int]]:
    """Numbers of texts that are hashed together; a long text stands alone."""
    some, size = [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > STRETCH:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(t)
    if some:
        yield some


def _of_texts(texts: list[bytes]) -> Iterator[tuple[list[int], Phrases]]:
    for some in _stretches(texts):
        yield some, Phrases(np.frombuffer(b"".join(texts[i] for i in some), np.uint8), np.cumsum([len(texts[i]) for i in some]))


def _by_phrase(rows: list[tuple[bytes]]) -> Windows:
    """A place for each phrase, with its anchor's hash and, to tell phrases of one anchor apart, its own."""
    texts = [t for (t,) in rows]
    counts, codes, parts = np.zeros(len(texts), np.int64), [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for some, p in _of_texts(texts):
        counts[some] = np.bincount(p.doc, minlength=len(some))
        if len(p.first):
            codes.append(p.small[p.anchor] * _SPREAD)  # anchors have small hashes: spread over the ranges again
            parts.append(p.hashes.ranges(p.first, p.last + STRING))
    return Windows(counts, np.empty(0, np.int64), np.arange(counts.sum()), np.concatenate(codes), np.concatenate(parts))


def _by_window(rows: list[tuple[bytes, list[int] | None, list[int] | None]]) -> Windows:
    """A place for each byte at which a window starts: settled in phrases that start earlier, open in those to check."""
    texts = [r[0] for r in rows]
    counts = np.maximum(np.array([len(t) for t in texts]) - STRING + 1, 0)
    bases = np.cumsum(counts) - counts
    settled, open_, codes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    # texts without phrases of either kind have no window to look up
    wanted = [i for i, (_, later, check) in enumerate(rows) if later or check]
    for picked, p in _of_texts([texts[i] for i in wanted]):
        some = [wanted[i] for i in picked]
        begins = np.searchsorted(p.doc, np.arange(len(some)))
        for kind, out in ((1, settled), (2, open_)):
            listed = [begins[j] + np.asarray(rows[i][kind], np.int64) for j, i in enumerate(some) if rows[i][kind]]
            mine = np.concatenate(listed) if listed else np.empty(0, np.int64)
            lengths = p.last[mine] - p.first[mine] + 1
            at = np.repeat(p.first[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            out.append(at + np.repeat((bases[some] - p.starts)[p.doc[mine]], lengths))
            if kind == 2:
                codes.append(p.hashes.ranges(at, at + STRING))
    return Windows(counts, np.concatenate(settled), np.concatenate(open_), np.concatenate(codes))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def string_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (hash of identifier and text) and spans of bytes, start and stop in turn, covered by strings of 50 bytes that also start in an earlier document."""
    rows = _keyed(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    phrases = sorted_places(rows, _by_phrase, size // _ANCHORS_IN)
    told = rows.join(phrases, "key", "left").select("doc_id", "key", "text", "later", "check")
    return repeated_spans(told, _by_window, STRING, size // _SINGLY_IN)


def _applied(docs: DataFrame, id_col: str, text_col: str, column: str, kind: pa.DataType, make) -> DataFrame:
    spans = string_spans(docs, id_col, text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_bytes, n_removed, n_spans, made = [], [], [], []
            for _, text, found in one_by_one(b):
                data, kept, at, gone = (text or "").encode("utf-8", "surrogatepass"), [], 0, 0
                for start, stop in zip(found[::2], found[1::2], strict=True) if found else ():
                    kept.append(data[at:start])
                    at, gone = stop, gone + stop - start
                n_bytes.append(len(data))
                n_removed.append(gone)
                n_spans.append(len(found or ()) // 2)
                made.append(make(b"".join([*kept, data[at:]])))
            columns = [pa.array(c, pa.int64()) for c in (n_bytes, n_removed, n_spans)]
            yield pa.record_batch([b.column(0), *columns, pa.array(made, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", column.split()[0]])

    rows = _keyed(docs, id_col, text_col).join(spans, "key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(apply, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")


def remove_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary): every text's bytes without those that :func:`string_spans` finds.

    Strings never cross documents, overlaps count, and spans are judged on the input. A null text
    counts as empty. A null identifier comes before all others; rows of one identifier do not count
    as earlier than each other, and repeated rows get the same answer. An empty table gives no rows.
    What is kept may break a character in two, so it is binary. Other columns are not read.
    """
    return _applied(docs, id_col, text_col, "kept binary", pa.binary(), bytes)


def string_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`remove_strings`, with kept_sha256 in place of what is kept."""
    return _applied(docs, id_col, text_col, "kept_sha256 string", pa.string(), lambda kept: hashlib.sha256(kept).hexdigest())

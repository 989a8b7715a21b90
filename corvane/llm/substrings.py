"""Substring deduplication: runs of words that an earlier document also has, by hashes of their windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.windows import Windows, one_by_one, repeated_spans

#: Words of the shortest factor that is a duplicate.
FACTOR = 13
# Fixed odd multipliers of the words of a run, for either hash.
_ODD = (np.random.default_rng(20240313).integers(1, 1 << 63, (2, FACTOR), dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Seeds:
    """Runs of ``FACTOR`` words of texts in turn, with two 64-bit hashes that have nothing in common."""

    def __init__(self, texts: list[bytes]) -> None:
        split = [t.split() for t in texts]
        words = np.array([len(w) for w in split], np.int64)
        self.counts = np.maximum(words - FACTOR + 1, 0)
        firsts = np.cumsum(words) - words  # of each text's words
        self._at = np.repeat(firsts - (np.cumsum(self.counts) - self.counts), self.counts) + np.arange(self.counts.sum())
        digest = xxhash.xxh3_128_digest
        self._words = np.frombuffer(b"".join([digest(w) for ws in split for w in ws]), "<u8").reshape(-1, 2)

    def hashes(self, half: int) -> np.ndarray:
        """Of every run, from one half of its words' 128-bit hashes, each multiplied by its place's odd number."""
        n = len(self._words) - FACTOR + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        h, out = _mixed(self._words[:, half]), np.zeros(n, np.uint64)
        for k in range(FACTOR):
            out += h[k : k + n] * np.uint64(_ODD[half][k])
        return _mixed(out)[self._at]


def _places(rows: list[tuple[bytes]]) -> Windows:
    """All seeds of the texts."""
    seeds = Seeds([t for (t,) in rows])
    return Windows(seeds.counts, np.empty(0, np.int64), np.arange(seeds.counts.sum()), seeds.hashes(0), second=seeds.hashes(1))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def factor_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (hash of identifier and text) and spans of words, start and stop in turn, covered by 13-word runs that an earlier document has.

    The reference is every document with a smaller identifier, indexed by the hashes of its runs
    of 13 words (seeds). Every seed of a document is looked up and seeds that are found and overlap
    or touch are one span, so no run of 13 words is missed. There is no Lempel-Ziv parse: a span may
    be stitched from several documents. The index is spread over tasks by hash range;
    documents are compared with all of it by sending it their seeds, packed by block, instead of
    the blocks of the reference visiting every document.

    Words are hashed whole by a 128-bit function, so no text makes seeds collide by its
    structure. A seed has two independent 64-bit hashes: one chooses the range, the other is
    compared there, so r ranges tell seeds apart by 64 + log2(r) bits, and r grows with the input.
    """
    rows = _keyed(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return repeated_spans(rows, _places, FACTOR, size // 6)


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every text without the words that :func:`factor_spans` finds.

    Words are runs of anything but blanks (0x20, 0x09-0x0D); kept ones are joined by one space.
    Spans are judged on the input. A null text has no words. A null identifier comes before all
    others; rows of one identifier do not count as earlier than each other, and repeated rows get
    the same answer. An empty table gives no rows. Other columns are not read.
    """
    return _applied(docs, id_col, text_col, "kept_text string", lambda kept: kept.decode("utf-8", "surrogatepass"))


def _applied(docs: DataFrame, id_col: str, text_col: str, column: str, make) -> DataFrame:
    spans = factor_spans(docs, id_col, text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, made = [], [], []
            for _, text, found in one_by_one(b):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                kept, at, gone = [], 0, 0
                for start, stop in zip(found[::2], found[1::2], strict=True) if found else ():
                    kept += words[at:start]
                    at, gone = stop, gone + stop - start
                n_words.append(len(words))
                n_removed.append(gone)
                made.append(make(b" ".join(kept + words[at:])))
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(made, pa.string())], names=["doc_id", "n_words", "n_removed", column.split()[0]])

    rows = _keyed(docs, id_col, text_col).join(spans, "key", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(apply, f"doc_id long, n_words long, n_removed long, {column}")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256, as :func:`remove_repeated` but with the kept text's digest."""
    return _applied(docs, id_col, text_col, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())

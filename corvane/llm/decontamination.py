"""Benchmark decontamination over a stored positional inverted index."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import stored
from corvane.llm.windows import one_by_one

#: Words of an index segment; a longer document is a segment of its own.
SEGMENT_WORDS = 500_000
#: Bytes of benchmark text that one pass over the index may send to the executors.
PASS_BYTES = 16 << 20
WINDOW = 10

#: Positions are delta encoded, terms front coded; a row is a segment, so sizes are checked at every row.
INDEX_FORMAT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(32 << 20)}

#: Bytes that end a word; the others, after lower-casing A-Z, are 0-9, a-z and all bytes of non-ASCII letters.
_BLANKS = bytes.maketrans(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]), b" " * (0x30 + 0x27 + 0x05)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text, in UTF-8; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANKS).split()


_SEGMENT = pa.schema(
    [("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("doc_words", pa.list_(pa.int32())),
     ("terms", pa.list_(pa.binary())), ("term_starts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))]
)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of every word of every whole text, one row for each segment of documents.

    Each task indexes the documents it reads, without a shuffle. A segment lists its documents
    with the place of their first word, its terms in byte order, and for each term its ascending
    positions. Documents stand one position apart, so no run of positions crosses from one to the next.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        seen: dict[bytes, int] = {}
        ids, starts, counts, terms = [], [], [], []
        at = 0

        def segment() -> pa.RecordBatch:
            nonlocal number
            names = sorted(seen)
            rank = np.empty(len(names), np.int64)
            rank[[seen[w] for w in names]] = np.arange(len(names))
            place = np.repeat(np.asarray(starts, np.int64), counts) + _within(counts)
            ranks = rank[np.concatenate(terms)] if terms else np.empty(0, np.int64)
            order = np.argsort(ranks, kind="stable")
            bounds = np.concatenate([[0], np.cumsum(np.bincount(ranks, minlength=len(names)))])
            row = [number, ids, starts, counts, names, bounds, place[order]]
            number += 1
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for b in batches:
            for doc, text in one_by_one(b):
                found = words(text)
                ids.append(doc)
                starts.append(at)
                counts.append(len(found))
                terms.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, len(found)))
                at += len(found) + 1
                if at >= SEGMENT_WORDS:
                    yield segment()
                    seen, ids, starts, counts, terms, at = {}, [], [], [], [], 0
        if ids:
            yield segment()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(index, "segment long, doc_ids array<long>, doc_starts array<int>, doc_words array<int>, terms array<binary>, term_starts array<int>, positions array<int>")


def _within(counts: list[int]) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    ends = np.cumsum(counts, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Phrases:
    """Windows of the benchmark's items over a numbered vocabulary, grouped by length."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int) -> None:
        vocabulary: dict[bytes, int] = {}
        groups: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            found = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
            size = min(window, len(found))
            for i in range(len(found) - size + 1 if size else 0):
                groups[size][tuple(found[i : i + size])].add(item)
        self.vocabulary = pa.array(list(vocabulary), pa.binary())
        self.groups = {n: (np.array(list(g), np.int64), list(g.values())) for n, g in groups.items()}


class Segment:
    """A stored segment's postings of the terms that a benchmark has."""

    def __init__(self, row: dict, vocabulary: pa.Array) -> None:
        self.doc_ids = row["doc_ids"].to_pylist()
        self.doc_starts = row["doc_starts"].to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc_words = row["doc_words"].to_numpy(zero_copy_only=False).astype(np.int64)
        self._starts = row["term_starts"].to_numpy(zero_copy_only=False)
        self._positions = row["positions"].to_numpy(zero_copy_only=False)
        self._ranks = pc.fill_null(pc.index_in(vocabulary, value_set=row["terms"]), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        ranks = self._ranks[terms]
        return np.where(ranks < 0, 0, self._starts[ranks + 1] - self._starts[ranks])

    def postings(self, term: int) -> np.ndarray:
        rank = self._ranks[term]
        return self._positions[self._starts[rank] : self._starts[rank + 1]]

    def docs_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, positions, side="right") - 1


def _exact(segment: Segment, window: np.ndarray, order: np.ndarray) -> np.ndarray:
    """First positions of a window: offset-adjusted postings, intersected from the rarest term on."""
    found = segment.postings(window[order[0]]) - order[0]
    for k in order[1:]:
        if not len(found):
            break
        listed = segment.postings(window[k])
        at = np.searchsorted(listed, found + k)
        found = found[listed[np.minimum(at, len(listed) - 1)] == found + k]
    return found


def _near(segment: Segment, window: np.ndarray, order: np.ndarray, reach: int) -> np.ndarray:
    """Documents where each term of a window stands within ``reach`` words of its rarest one."""
    found = segment.postings(window[order[0]])
    docs = segment.docs_of(found)
    low = np.maximum(found - reach, segment.doc_starts[docs])
    high = np.minimum(found + reach, segment.doc_starts[docs] + segment.doc_words[docs] - 1)
    for k in order[1:]:
        if not len(docs):
            break
        listed = segment.postings(window[k])
        at = np.searchsorted(listed, low)
        fits = listed[np.minimum(at, len(listed) - 1)]
        fits = (fits >= low) & (fits <= high)
        docs, low, high = docs[fits], low[fits], high[fits]
    return docs


_FOUND = "doc_key string, doc_id long, n_words int, spans array<struct<start:int,stop:int>>, items array<string>, near array<string>"


def _search(index: DataFrame, items: list[tuple[str, str | None]], window: int, slop: int | None) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].values for c in b.schema.names if c != "segment"}
                yield of_segment(b.column("segment")[i].as_py(), Segment(row, phrases.vocabulary), phrases)

    def of_segment(number: int, segment: Segment, phrases: Phrases) -> pa.RecordBatch:
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        exact, near = defaultdict(set), defaultdict(set)
        for size, (windows, owners) in phrases.groups.items():
            counts = segment.frequencies(windows)
            for w in np.flatnonzero(counts.min(axis=1) > 0):
                order = np.argsort(counts[w], kind="stable")
                found = _exact(segment, windows[w], order)
                for doc, at in zip(segment.docs_of(found).tolist(), found.tolist(), strict=True):
                    hits[doc].append((at, at + size))
                    exact[doc] |= owners[w]
                if slop is not None:
                    for doc in np.unique(_near(segment, windows[w], order, size - 1 + slop)).tolist():
                        near[doc] |= owners[w]
        n = len(segment.doc_ids)
        spans = [_joined(hits[d], int(segment.doc_starts[d])) if d in hits else [] for d in range(n)]
        columns = [[f"{number}:{d}" for d in range(n)], segment.doc_ids, segment.doc_words.tolist(), spans, [sorted(exact.get(d, ())) for d in range(n)], [sorted(near.get(d, ())) for d in range(n)]]
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        types = [pa.string(), pa.int64(), pa.int32(), pa.list_(span), pa.list_(pa.string()), pa.list_(pa.string())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_key", "doc_id", "n_words", "spans", "items", "near"])

    return index.mapInArrow(search, _FOUND)


def _joined(spans: list[tuple[int, int]], base: int) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [{"start": a - base, "stop": b - base} for a, b in out]


def search_index(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each indexed document: doc_id, n_words, spans, items and near.

    ``spans`` are the maximal runs of words (start, stop) inside occurrences of a window:
    ``window`` consecutive words of an item, or all of a shorter one that has any. ``items``
    are the ids, as strings, of items with occurring windows; ``near`` those with a window
    whose words all stand within ``slop`` words more than its length of its rarest word,
    in any order (empty where slop is None).

    The benchmark is sent out in passes of at most ``PASS_BYTES`` of text each; a larger one
    takes more passes over the stored index, whose findings are joined by document.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1
    found = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        found.append(_search(index, [(r.item, r.text) for r in part.collect()], window, slop))
    if passes == 1:
        return found[0].drop("doc_key")
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return (
        every.groupBy("doc_key")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
        .withColumn("spans", _united("spans"))
        .drop("doc_key")
    )


def _united(spans: str) -> F.Column:
    """Maximal runs of a column of spans."""
    return F.expr(f"""
        aggregate(array_sort({spans}), cast(array() as array<struct<start:int,stop:int>>), (done, s) ->
            if(size(done) > 0 and element_at(done, -1).stop >= s.start,
               concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).stop, s.stop) as stop))),
               concat(done, array(s))))""")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index ``docs``, store the index in the shared folder, and search it for the benchmark.

    See :func:`search_index`. A null or empty text has no words, so no hits; a benchmark without
    rows or words finds nothing; identifiers, null or repeated, are carried as they are; an empty
    table gives no rows. Other columns are not read.
    """
    index = stored(build_index(docs, id_col, text_col), **INDEX_FORMAT)
    return search_index(index, benchmark, window, slop)


def contamination_report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near from :func:`contamination`."""
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns unchanged. A row with a null identifier stays."""
    found = contamination(docs, benchmark, window, None, id_col, text_col)
    gone = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def items_digest(items: Iterable[str]) -> str:
    """The digest that :func:`contamination_report` gives for these item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

"""SimHash near-duplicates at a similarity of word shingles that a short fingerprint cannot hold apart.

Two documents that share four fifths of their shingles differ in about ten of 64 bits, too many for
pigeonhole keys. So a document's fingerprint has ``BLOCKS`` blocks of 64 bits, each the SimHash of a few
shingles dealt to it by their hashes. Close documents share a block, blocks are joined,
summaries rule most candidates out by their Hamming distance, and whole texts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.components import components
from corvane.llm.storage import discard, stored

#: Words of a shingle, and the similarity from which two documents are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
SEED = 42
#: Blocks of a fingerprint.
BLOCKS = 20
#: Documents of a key from which they are compared with a drawn one first, and rounds of that.
MANY, TURNS = 128, 2
#: Documents of a key that are joined with each other; those of larger keys are compared in parts of so many, or of so many shingles.
FEW, PART, PART_SHINGLES = 16, 2000, 1_000_000
#: A summary is a SimHash and the parities of cells, of so many words of 64 bits each; the SimHash counts between sets of ``LARGE`` shingles or more.
SIM_WORDS, CELL_WORDS, LARGE = 8, 4, 128
_SUMMARY = [f"s{i}" for i in range(SIM_WORDS + CELL_WORDS)]
#: Documents, or pairs of them, that a Python step takes at a time.
BATCH_ROWS, BATCH_PAIRS = 1000, 250
#: Guards sizes and distances against the last bits of a division.
_EPS = 1e-9


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles; the whole sequence is one where there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, as for SimHash
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(lengths + 1) - 1
    starts = (stops - lengths).tolist() or [0]
    ends = stops[min(shingle, len(words)) - 1 :].tolist() or [0]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=False)], "<u8"))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + _EPS >= similarity * (len(a) + len(b) - both)


def sketch(found: np.ndarray) -> bytes:
    """Parities of the elements in each of a power of two of cells, at least as many as elements."""
    cells = max(64, 1 << (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def possible(n: int, one: bytes, m: int, two: bytes, similarity: float) -> bool:
    """False only for sets of n and m elements that are not similar: their parities differ in no more cells than they in elements."""
    if min(n, m) + _EPS < similarity * max(n, m):
        return False
    if len(one) < len(two):
        one, two = two, one
    x, y, half = int.from_bytes(one, "little"), int.from_bytes(two, "little"), 4 * len(one)
    while 2 * half > 8 * len(two):  # cells of the larger sketch fall together in the smaller
        x, half = (x & ((1 << half) - 1)) ^ (x >> half), half // 2
    return (x ^ y).bit_count() <= (n + m) * (1 - similarity) / (1 + similarity) + _EPS


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits that more than half of the hashes of each stretch have."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(first, len(hashes)))
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8")


def keys(found: np.ndarray, similarity: float) -> np.ndarray:
    """Hashes of the blocks of a shingle set's fingerprint that are not empty.

    A set of up to n shingles is dealt into as many parts as leave a block ``-1.1 / ln(similarity)``
    shingles at most, of which ``BLOCKS`` parts are blocks. A block is equal in two similar sets where
    no shingle that they do not share falls into it: with a chance of 0.28 or more, so that
    all of them differ with a chance of 0.0013 or less at the very threshold. Sizes are in classes
    of a factor of two; a set is keyed for the next class too if sets of it may be similar.
    """
    held = BLOCKS * max(1.0, -1.115 / log(similarity))
    own = max(0, ceil(log2(len(found) / held)))
    classes = [own] + [own + 1] * (len(found) / similarity + _EPS > held * 2**own)
    out = []
    for c in classes:
        mixed = _mixed(found ^ np.uint64((c + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = ((mixed >> np.uint64(32)) * np.uint64(BLOCKS << c) >> np.uint64(32)).astype(np.int64)
        mine = np.flatnonzero(at < BLOCKS)
        mine = mine[np.argsort(at[mine], kind="stable")]
        if len(mine):
            names = at[mine]
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            blocks = _majority(_mixed(mixed[mine]), first).ravel()
            out.append(_mixed(blocks ^ _mixed(names[first].astype(np.uint64) + np.uint64(c << 32))))
    return np.concatenate([np.empty(0, np.uint64), *out]).view("<i8")


def _ones(words: np.ndarray) -> np.ndarray:
    """How many rows of 64-bit words have each bit: eight counters to a word, which 255 rows cannot overflow."""
    lanes = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    return sums.view(np.uint8).sum(axis=0, dtype=np.int64)


def summary(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set and the parities of its cells, as longs."""
    salts = np.arange(1, SIM_WORDS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    ones = np.zeros(64 * SIM_WORDS, np.int64)
    for start in range(0, len(found), 16384):  # bounds what a long text takes
        ones += _ones(_mixed(found[start : start + 16384, None] ^ salts[None, :]))
    sim = np.packbits(2 * ones > len(found), bitorder="little").view("<i8")
    cells = np.bincount((found & np.uint64(64 * CELL_WORDS - 1)).astype(np.int64), minlength=64 * CELL_WORDS) & 1
    return np.concatenate([sim, np.packbits(cells.astype(np.uint8), bitorder="little").view("<i8")])


def most_bits(similarity: float) -> int:
    """Differing bits of two SimHashes up to which sets may be similar: five deviations beyond what is expected."""
    bits, p = 64 * SIM_WORDS, acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * p + 5 * sqrt(bits * p * (1 - p)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _profiles(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, n (shingles), the summary, the keys of the blocks and the sketch of each document, from one reading of it."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, bits, held, sketches = [], [], [], []
            for i in range(b.num_rows):
                found = shingles(b.column(1)[i].as_py(), shingle)
                sizes.append(len(found))
                bits.append(summary(found))
                held.append(keys(found, similarity))
                sketches.append(sketch(found))
            if sizes:
                both = np.array(bits)
                columns = [b.column(0), pa.array(sizes, pa.int32()), *[pa.array(np.ascontiguousarray(both[:, j])) for j in range(len(_SUMMARY))]]
                yield pa.record_batch([*columns, pa.array(held, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["node", "n", *_SUMMARY, "keys", "sketch"])

    return texts.mapInArrow(compute, f"node long, n int, {', '.join(f'{c} long' for c in _SUMMARY)}, keys array<long>, sketch binary")


def _together(rows: DataFrame) -> DataFrame:
    """Rows whose key several nodes have, with their number as held; most keys have one."""
    return rows.withColumn("held", F.count("*").over(Window.partitionBy("key"))).where("held > 1")


def _may_be_similar(x: str, y: str, similarity: float) -> Column:
    """What the sizes and summaries of two rows leave possible."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")

    def apart(words: list[str]) -> Column:
        return reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in words])

    sizes = F.least(n, m) + _EPS >= similarity * F.greatest(n, m)
    cells = apart(_SUMMARY[SIM_WORDS:]) <= (n + m) * ((1 - similarity) / (1 + similarity)) + _EPS  # no more cells differ than elements
    return sizes & cells & ((F.least(n, m) < LARGE) | (apart(_SUMMARY[:SIM_WORDS]) <= most_bits(similarity)))


def _row(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("node", "n", *_SUMMARY)])


def _possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [possible(*x, similarity) for x in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, two = (sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(check, "a long, b long")


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar, from their whole texts."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, None
        for batch in batches:
            a, b, kept = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(batch.num_rows):
                if a[i] != now:
                    now, left = a[i], shingles(batch.column(2)[i].as_py(), shingle)
                if similar(left, shingles(batch.column(3)[i].as_py(), shingle), similarity):
                    kept.append((a[i], b[i]))
            yield pa.record_batch([pa.array([p[n] for p in kept], pa.int64()) for n in (0, 1)], names=["a", "b"])

    one, two = (texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(check, "a long, b long")


def _grouped(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of keys whose nodes are in several components so far, with the component as group."""
    group = components(found)
    rows = shared.drop("group").join(group, shared["node"] == group["node"], "left").select(shared["key"], shared["node"], "n", *_SUMMARY, "held", F.coalesce("component", shared["node"]).alias("group"))
    whole = Window.partitionBy("key")
    return stored(rows.withColumn("several", F.min("group").over(whole) != F.max("group").over(whole)).where("several").drop("several"))


def _spanning(groups: np.ndarray, sets: list[np.ndarray], candidates: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Links between similar ones of the candidate pairs of ``sets`` that connect what those connect, one less than it has groups; ``groups`` are connected already.

    A set's elements are marked, and what each of its candidates shares with it is counted in one pass.
    """
    group = np.unique(groups, return_inverse=True)[1]
    numbers = np.unique(np.concatenate([*sets, np.empty(0, np.int64)]), return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    of = lambda i: numbers[ends[i] - sizes[i] : ends[i]]
    marks, found = np.zeros(len(numbers), bool), []
    for p, q in candidates:
        if not len(p):
            continue
        first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        for x, ys in zip(p[first].tolist(), np.split(q, first[1:]), strict=True):
            ys = ys[group[ys] != group[x]]
            if not len(ys):
                continue
            marks[of(x)] = True
            both = np.add.reduceat(marks[np.concatenate([of(y) for y in ys.tolist()])], np.append(0, np.cumsum(sizes[ys])[:-1]), dtype=np.int64)
            marks[of(x)] = False
            for y in ys[both + _EPS >= similarity * (sizes[x] + sizes[ys] - both)].tolist():
                if group[x] != group[y]:
                    group[group == group[y]] = group[x]
                    found.append((x, y))
    return found


def _between(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) that connect the similar documents of different groups of a key.

    A key's rows are dealt into parts of about ``PART`` documents, or of ``PART_SHINGLES`` if they are long, and a task compares
    two parts at a time, in full: what sizes and summaries leave possible by the documents' shingles, which are brought along. Only links
    that span its groups come out of it, fewer than it has documents. No key is too large for that, and none of its pairs is left out.
    """
    last, most, edge = most_bits(similarity), (1 - similarity) / (1 + similarity), 256

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle).view("<i8") for t in b.column("text")]
            yield pa.record_batch([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    each = rows.groupBy("node").agg(F.collect_list(F.struct("key", "now", "total")).alias("at"), *[F.first(c).alias(c) for c in ("n", *_SUMMARY, "group")])
    cuts = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(cut, "node long, shingles array<long>")
    keyed = each.join(cuts, "node").withColumn("at", F.explode("at")).select("*", "at.*").drop("at")
    parts = F.greatest(F.ceil(F.col("now") / PART), F.ceil(F.col("total") / PART_SHINGLES)).cast("long")
    dealt = keyed.withColumns({"part": F.pmod(F.xxhash64("node"), parts), "other": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
    tiles = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", *_SUMMARY, "group", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        n, node, group, part = (table.column(c).to_numpy() for c in ("n", "node", "group", "part"))
        words = np.stack([table.column(c).to_numpy() for c in _SUMMARY], axis=1).view("<u8")
        sets = [x for chunk in table.column("shingles").chunks if len(chunk) for x in np.split(chunk.flatten().to_numpy(), np.diff(chunk.offsets.to_numpy()).cumsum()[:-1])]
        i, j, n = table.column("i")[0].as_py(), table.column("j")[0].as_py(), n.astype(np.int64)
        one, two = np.flatnonzero(part == i), np.flatnonzero(part == j)

        def possible() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for start in range(0, len(one), edge):
                for beyond in range(0, len(two), 8 * edge):
                    x, y = one[start : start + edge, None], two[None, beyond : beyond + 8 * edge]
                    maybe = (group[x] != group[y]) & (np.minimum(n[x], n[y]) + _EPS >= similarity * np.maximum(n[x], n[y]))
                    if i == j:
                        maybe &= x < y
                    apart = sum(np.bitwise_count(words[x, w] ^ words[y, w]).astype(np.int64) for w in range(SIM_WORDS, SIM_WORDS + CELL_WORDS))
                    p, q = np.nonzero(maybe & (apart <= (n[x] + n[y]) * most + _EPS))
                    p, q = x[p, 0], y[0, q]
                    bits = np.bitwise_count(words[p, :SIM_WORDS] ^ words[q, :SIM_WORDS]).sum(axis=1)
                    kept = (np.minimum(n[p], n[q]) < LARGE) | (bits <= last)
                    yield p[kept], q[kept]

        ends = np.sort(node[np.array(_spanning(group, sets, possible(), similarity), np.int64).reshape(-1, 2)], axis=1)
        return pa.table({"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])})

    return tiles.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def links(texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) that connect the similar nodes of ``texts`` (node, text) that share a block.

    Documents that share a block are first compared with that of them which shares most blocks
    with others: of a group of copies, the original. Documents of crowded blocks are then compared
    with some drawn by a hash. What is connected needs no more comparison, so after that only
    documents of different components are: all of them, where many share a block part by part (:func:`_between`).
    Sizes, summaries and sketches rule most pairs out before texts are fetched.
    """
    profiles = stored(_profiles(texts, shingle, similarity), BATCH_ROWS)
    sketches = profiles.select("node", "n", "sketch")
    keyed = _together(profiles.select(F.explode("keys").alias("key"), "node"))
    shared = stored(keyed.join(profiles.select("node", "n", *_SUMMARY), "node"))
    ordered = lambda rows, x, y: rows.select(F.least(f"{x}.node", f"{y}.node").alias("a"), F.greatest(f"{x}.node", f"{y}.node").alias("b")).distinct()

    def weighed(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        return pairs, stored(_similar(stored(_possible(pairs, sketches, similarity)), texts, shingle, similarity), BATCH_PAIRS)

    def checked(rows: DataFrame, x: str, y: str, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        return weighed(ordered(rows.where(F.col(f"{x}.node") != F.col(f"{y}.node")).where(_may_be_similar(x, y, similarity)), x, y), tried)

    degrees = shared.groupBy("node").agg(F.count("*").alias("degree"))
    centres = shared.join(degrees, "node").groupBy("key").agg(F.max_by(_row(), F.struct("degree", -F.col("node"))).alias("y"))
    tried, found = checked(shared.select("key", _row().alias("x")).join(centres, "key"), "x", "y", None)
    rows = _grouped(shared, found)
    for turn in range(TURNS):
        many = rows.where(F.col("held") > MANY)
        if many.isEmpty():
            break
        drawn = many.groupBy("key").agg(F.min_by(F.struct(_row().alias("row"), "group"), F.xxhash64("node", F.lit(turn))).alias("c"))
        apart = many.select("key", "group", _row().alias("x")).join(drawn, "key").where(F.col("group") != F.col("c.group"))
        fresh, more = checked(apart.select("x", F.col("c.row").alias("y")), "x", "y", tried)
        tried, found = tried.unionAll(fresh), found.unionAll(more)
        rows = _grouped(rows, found)
    whole = Window.partitionBy("key")
    rows = rows.withColumns({"now": F.count("*").over(whole), "total": F.sum("n").over(whole)})
    few = rows.where(F.col("now") <= FEW)
    # the largest component of a key needs no comparison within, so one of a pair is of another
    counted = few.groupBy("key", "group").agg(F.count("*").alias("c"))
    main = counted.groupBy("key").agg(F.max_by("group", F.struct("c", "group")).alias("main"))
    others = few.join(main, "key").where("group <> main").select("key", F.col("group").alias("mine"), _row().alias("x"))
    pairs = others.join(few.select("key", "group", _row().alias("y")), "key").where("group <> mine")
    pairs = ordered(pairs.where(_may_be_similar("x", "y", similarity)), "x", "y")
    _, last = weighed(pairs, tried)
    crowded = stored(_between(stored(rows.where(F.col("now") > FEW)), texts, shingle, similarity), BATCH_PAIRS)
    for done in (profiles, shared, rows):
        discard(done)
    return found.unionAll(last).unionAll(crowded)


def shingle_dedup(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of the smallest identifier of each group of near-duplicates; all columns unchanged.

    A group is what links of shingle sets with a Jaccard similarity of ``similarity`` or more
    connect. Every link is checked on whole texts; a pair at the threshold has no block in common, and
    so may be missed, with a chance of about 0.001. Texts are lower-cased (A-Z) and split at blanks; those that
    are null or without words are alike. A row with a null identifier stays, and links nothing.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    group = components(links(texts, shingle, similarity))
    gone = group.where("node <> component").select(F.col("node").alias("__gone"))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")

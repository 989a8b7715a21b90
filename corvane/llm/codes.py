"""Vectors compressed to codes of 16 bytes, their nearest codebook entries found by Orchard's search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import stored
from corvane.llm.vectors import by_task, finite, integers, summed, totals

#: Equal parts of a vector, entries of each part's codebook (a byte each: 256 at most), rounds of assigning and replacing.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows that one label's rows are dealt to when its total goes back to them.
SALTS = 64


def neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by their distance from it, and those squared distances."""
    between = np.square(entries[:, None, :] - entries[None, :, :]).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    return order, np.take_along_axis(between, order, axis=1)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest entry (ties to the lower index) and the squared distance, by Orchard's search.

    A point walks down the neighbour list of its best entry so far and jumps to the list of an entry
    that is better. Entries it has met are marked and not measured again. Once the list's
    entries lie beyond twice the best distance, no entry that is left can be as near. All
    points take their steps together, and those that have ended leave.
    """
    order, far = neighbours(entries)
    k = len(entries)
    first = np.argsort(entries[:, 0], kind="stable")
    best = first[np.minimum(np.searchsorted(entries[first, 0], points[:, 0]), k - 1)]  # any start is right, a close one ends sooner
    distance = np.square(points - entries[best]).sum(axis=1)
    marked = np.zeros((len(points), k), bool)
    marked[np.arange(len(points)), best] = True
    place = np.full(len(points), -1)
    walking = np.arange(len(points))
    while len(walking):
        place[walking] += 1
        walking = walking[place[walking] < k]
        walking = walking[far[best[walking], place[walking]] <= 4 * distance[walking]]  # squares: twice the distance
        entry = order[best[walking], place[walking]]
        fresh = ~marked[walking, entry]
        rows, entry = walking[fresh], entry[fresh]
        marked[rows, entry] = True
        measured = np.square(points[rows] - entries[entry]).sum(axis=1)
        better = (measured < distance[rows]) | ((measured == distance[rows]) & (entry < best[rows]))
        rows = rows[better]
        best[rows], distance[rows], place[rows] = entry[better], measured[better], -1  # an equal entry may come before itself
    return best, distance


def _parts(batch: pa.Array, width: int, parts: int) -> np.ndarray:
    """Points by (vector, part, component)."""
    return integers(batch, width).reshape(-1, parts, width // parts)


def train(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Codebooks (part, entry, component) from usable vectors of ``width`` components.

    They start as the parts of the vectors with the smallest identifiers. Each round assigns all
    parts and replaces an entry by the exact floor of its parts' mean; an entry without parts stays.
    A task sums what it reads, so parts x entries rows of totals reach the driver, however many the vectors.
    """
    start = vectors.where(F.col(id_col).isNotNull()).orderBy(id_col, vector_col).limit(entries).select(vector_col).toArrow()
    books = _parts(start.column(0).combine_chunks(), width, parts).transpose(1, 0, 2)
    k, part_width = books.shape[1], width // parts
    if not k:
        return books
    for _ in range(rounds):

        def assign(b: pa.RecordBatch, books: np.ndarray = books) -> np.ndarray:
            points = _parts(b.column(0), width, parts)
            return np.concatenate([totals(points[:, p], nearest(points[:, p], books[p])[0], k) for p in range(parts)])

        found = summed(vectors.select(vector_col).mapInArrow(by_task(assign, parts * k, part_width), "slot long, total array<long>"), "slot", part_width)
        books = books.copy()
        for slot, (n, *sums) in found.items():
            books[slot // k, slot % k] = [s // n for s in sums]
    return books


def encode(vectors: DataFrame, books: np.ndarray, keep: list[str], vector_col: str = "embedding") -> DataFrame:
    """The columns ``keep``, code (binary, a byte for each part) and error (squared distances summed over parts)."""
    parts, _, part_width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _parts(b.column(len(keep)), parts * part_width, parts)
            found = [nearest(points[:, p], books[p]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum(f[1] for f in found)
            yield pa.record_batch([*b.columns[:-1], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=[*keep, "code", "error"])

    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)
    return vectors.select(*keep, vector_col).mapInArrow(run, f"{kinds}, code binary, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable row of (vec_id, embedding, label): vec_id, label, code (binary), error, label_error and codebooks_sha256.

    Rows whose vector is null or has a null, infinite or undefined component are dropped. The width
    is that of the usable vector with components of the smallest vec_id, and has to be a multiple of
    ``parts``; vectors of another width have no code: null code and error, and no part in codebooks and sums.
    label_error sums the error over equal labels, null labels together. Repeated rows each count
    and appear; a null vec_id is no start of a codebook. Fewer than ``entries`` vectors make as many
    entries. An empty table gives no rows. Other columns are not read.
    """
    usable = vectors.where(finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    first = usable.where(F.size("embedding") > 0).orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    width = first[0] if first else 0
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    coded = usable.where(F.size("embedding") == width) if width else usable.limit(0)
    books = train(coded, width, parts, entries, rounds) if width else np.zeros((parts, 0, 0), np.int64)
    others = usable.where(F.size("embedding") != width).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    done = stored((encode(coded, books, ["vec_id", "label"]) if books.shape[1] else others.limit(0)).unionByName(others))
    # a label may hold a third of all rows: its total is a row for each salt
    salted = done.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    rows = done.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, rows["label"].eqNullSafe(salted["of"]) & (rows["salt"] == salted["salt_of"]))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def code_report(vectors: DataFrame) -> DataFrame:
    """As :func:`compressed`, the code as lower-case hex digits and without the label."""
    return compressed(vectors).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def _codes_sql(parts: int, entries: int, rounds: int, part_width: int) -> str:
    axes = range(1, part_width + 1)
    gap = " + ".join(f"(p{j} - c{j}) * (p{j} - c{j})" for j in axes)
    steps = []
    for r in range(rounds + 1):
        steps.append(f"near{r} AS (SELECT row, part, min(({gap}) * {entries} + entry) AS best FROM pieces JOIN book{r} USING (part) GROUP BY row, part)")
        if r < rounds:
            means = ", ".join(f"((sum(p{j}) - ((sum(p{j}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m{j}" for j in axes)
            steps.append(f"mean{r} AS (SELECT part, best % {entries} AS entry, {means} FROM pieces JOIN near{r} USING (row, part) GROUP BY part, best % {entries})")
            kept = ", ".join(f"coalesce(m{j}, c{j}) AS c{j}" for j in axes)
            steps.append(f"book{r + 1} AS (SELECT part, entry, {kept} FROM book{r} LEFT JOIN mean{r} USING (part, entry))")
    columns = ", ".join(f"v[part * {part_width} + {j}] AS p{j}" for j in axes)
    starts = ", ".join(f"p{j} AS c{j}" for j in axes)
    listed = ", ".join(f"c{j}" for j in axes)
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        pieces AS MATERIALIZED (SELECT row, part, {columns} FROM kept, (SELECT unnest(range({parts})) AS part)),
        book0 AS (SELECT part, row AS entry, {starts} FROM pieces WHERE row < {entries}),
        {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
        codes AS (
            SELECT row, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error
            FROM near{rounds} GROUP BY row
        ),
        digest AS (SELECT sha256(string_agg(concat_ws(',', {listed}), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM kept JOIN codes USING (row), digest
    """


#: For vectors of 64 components.
CODES_SQL = _codes_sql(PARTS, ENTRIES, ROUNDS, 4)

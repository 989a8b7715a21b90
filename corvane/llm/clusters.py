"""Centroid clustering with nearest centroids by the equal-average equal-variance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.storage import stored
from corvane.llm.vectors import by_task, finite, integers, summed, totals

#: Components of a vector, centroids, rounds, and the seed that the starting vectors are drawn by.
WIDTH, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: Bounds in floating point are lowered by this share, so that rounding never rejects a centroid that is as near.
_SLACK = 1e-9


def _deviation(rows: np.ndarray) -> np.ndarray:
    """The length of what is left of each row after its mean is taken off."""
    return np.sqrt(np.square(rows - rows.mean(axis=1, keepdims=True)).sum(axis=1))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid (ties to the smaller number) and the squared distance.

    Centroids stand in order of their component sums. A point takes them from its own sum
    outward, always the one of closer sum on either side. With w components, sums apart by s and deviations
    apart by v, a squared distance is at least s²/w + v²: once s²/w alone is above the best distance,
    all centroids further out are too and the point is done; where only both together are, this one is
    passed over. Distances are measured in integers.
    """
    width, k = points.shape[1], len(centroids)
    sums = centroids.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    means = sums[order].astype(np.float64)
    spread = _deviation(centroids)[order]
    at = points.sum(axis=1).astype(np.float64)
    own = _deviation(points)
    up = np.searchsorted(means, at)
    down = up - 1
    best = np.full(len(points), -1)
    distance = np.full(len(points), np.iinfo(np.int64).max)
    edge = np.concatenate([[-np.inf], means, [np.inf]])  # beyond either end
    walking = np.arange(len(points))
    while len(walking):
        below, above = at[walking] - edge[down[walking] + 1], edge[up[walking] + 1] - at[walking]
        upward = above < below
        apart = np.where(upward, above, below)
        going = apart**2 / width * (1 - _SLACK) <= distance[walking]
        going &= np.isfinite(apart)
        walking, upward, apart = walking[going], upward[going], apart[going]
        slot = np.where(upward, up[walking], down[walking])
        up[walking] += upward
        down[walking] -= ~upward
        bound = (apart**2 / width + (own[walking] - spread[slot]) ** 2) * (1 - _SLACK) - 1
        hopeful = bound <= distance[walking]
        rows, number = walking[hopeful], order[slot[hopeful]]
        measured = np.square(points[rows] - centroids[number]).sum(axis=1)
        better = (measured < distance[rows]) | ((measured == distance[rows]) & (number < best[rows]))
        rows = rows[better]
        best[rows], distance[rows] = number[better], measured[better]
    return best, distance


def train(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> np.ndarray:
    """Centroids of usable (vec_id, embedding) rows: k vectors of the smallest SHA-256 of ``seed:vec_id``, then ``rounds`` of means, floored exactly.

    A task sums what it reads, so k rows of totals reach the driver in each round.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.where("vec_id IS NOT NULL").orderBy(name, "embedding").limit(k).select("embedding").toArrow()
    centroids = integers(start.column(0).combine_chunks(), width)
    if not len(centroids):
        return centroids
    for _ in range(rounds):

        def assign(b: pa.RecordBatch, centroids: np.ndarray = centroids) -> np.ndarray:
            points = integers(b.column(0), width)
            return totals(points, nearest(points, centroids)[0], len(centroids))

        found = summed(vectors.select("embedding").mapInArrow(by_task(assign, len(centroids), width), "slot long, total array<long>"), "slot", width)
        centroids = centroids.copy()
        for slot, (n, *sums) in found.items():
            centroids[slot] = [s // n for s in sums]
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of usable (vec_id, embedding) rows."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance = nearest(integers(b.column(1), width), centroids)
            yield pa.record_batch([b.column(0), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH) -> DataFrame:
    """One row per usable row of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Rows whose vector is null, not of ``width`` components, or has a null, infinite or undefined one
    are dropped. Repeated rows each count and appear; a null vec_id is no starting centroid. Fewer
    than k rows make as many centroids, of which equal ones leave all but the first empty. An
    empty table gives no rows. Other columns are not read.
    """
    usable = vectors.where(finite(F.col("embedding")) & (F.size("embedding") == width)).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    centroids = train(usable, k, rounds, seed, width)
    if not len(centroids):
        columns = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], columns)
    rows = stored(assign(usable, centroids))
    spent = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows at most
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(i, spent[i], sum(spent.values()), digest[i]) for i in sorted(spent)]
    clusters = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql(k: int, rounds: int, seed: int, width: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"gap{r} AS (SELECT row, cluster, sum((x - c) * (x - c))::BIGINT AS d FROM cells JOIN centre{r} USING (pos) GROUP BY row, cluster)")
        steps.append(f"near{r} AS (SELECT row, min(d * {k} + cluster) AS best FROM gap{r} GROUP BY row)")
        if r < rounds:
            steps.append(
                f"mean{r} AS (SELECT best % {k} AS cluster, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m"
                f" FROM cells JOIN near{r} USING (row) GROUP BY best % {k}, pos)"
            )
            steps.append(f"centre{r + 1} AS (SELECT cluster, pos, coalesce(m, c) AS c FROM centre{r} LEFT JOIN mean{r} USING (cluster, pos))")
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS row, vec_id,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
            FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        cells AS MATERIALIZED (SELECT row, pos, v[pos] AS x FROM kept, (SELECT unnest(range(1, {width + 1})) AS pos)),
        centre0 AS (SELECT row AS cluster, pos, x AS c FROM cells WHERE row < {k}),
        {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
        digests AS (SELECT cluster, sha256(string_agg(c::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM centre{rounds} GROUP BY cluster),
        placed AS (SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance FROM kept JOIN near{rounds} USING (row))
        SELECT vec_id, placed.cluster, distance,
               (sum(distance) OVER (PARTITION BY placed.cluster))::BIGINT AS cluster_inertia,
               (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM placed JOIN digests USING (cluster)
    """


CLUSTERS_SQL = _clusters_sql(CENTROIDS, ROUNDS, SEED, WIDTH)

"""What the operators on embeddings share: usable vectors, integer components, sums of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a component to 1, and the largest number of steps: squares summed over 16,384 components stay within a long.
STEPS, LARGEST = 256, 1 << 23


def finite(vector: Column) -> Column:
    """Whether a vector is not null and none of its components is null, infinite or not a number."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce(F.forall(vector, usable), F.lit(False))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """A row of floor(256 * x) for each vector; an error beyond ``LARGEST``, where distances would no longer be exact."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    steps = np.floor(STEPS * flat)
    if len(steps) and np.abs(steps).max() > LARGEST:
        raise ValueError(f"a vector component is beyond {LARGEST // STEPS}")
    return steps.astype(np.int64).reshape(-1, width)


def totals(points: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """For each of k groups its number of points and their sum by component, exact below 2**53."""
    counts = np.bincount(index, minlength=k)
    sums = [np.bincount(index, weights=points[:, j], minlength=k) for j in range(points.shape[1])]
    return np.stack([counts, *sums], axis=1).astype(np.int64)


def summed(rows: DataFrame, key: str, width: int) -> dict[int, list[int]]:
    """The totals of all tasks by ``key`` (count, then components); as many rows as there are groups, so they may come to the driver."""
    sums = [F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width + 1)]
    return {r[0]: [int(x) for x in r[1:]] for r in rows.groupBy(key).agg(*sums).collect()}


def by_task(compute, groups: int, width: int):
    """For mapInArrow: the totals that ``compute`` gives for each batch (groups x (width + 1)), summed over a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((groups, width + 1), np.int64)
        for b in batches:
            held += compute(b)
        used = np.flatnonzero(held[:, 0])
        yield pa.record_batch([pa.array(used), pa.array(held[used].tolist(), pa.list_(pa.int64()))], names=["slot", "total"])

    return run

"""The job table: folds, claims and transitions, as rewrites of its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIVE = ("pending", "running", "failed")
MAX_ATTEMPTS, MAX_PARKS = 3, 20


def enqueue(jobs: DataFrame) -> DataFrame:
    """One row for each live key: highest priority and time, the latest payload, pending again if it had failed, no attempts or parks yet."""
    live = jobs.where(F.col("state").isin(*LIVE))
    last = lambda c: F.max_by(c, "id")
    folded = live.groupBy("dedupe_key").agg(
        F.max("id").alias("id"), F.max("priority").alias("priority"), F.max("not_before").alias("not_before"), last("payload").alias("payload"), last("state").alias("state")
    )
    state = F.when(F.col("state") == "failed", "pending").otherwise(F.col("state"))
    return folded.withColumns({"state": state, "attempts": F.lit(0), "parks": F.lit(0)})


def claim(jobs: DataFrame, kind: str, now: int, limit: int) -> DataFrame:
    """The next due jobs of a kind, newest first within a priority, as running with one more attempt."""
    due = jobs.where((F.col("state") == "pending") & (F.col("kind") == kind) & (F.col("not_before") <= now))
    taken = due.orderBy(F.desc("priority"), F.desc("id")).limit(limit)
    return taken.withColumns({"state": F.lit("running"), "attempts": F.col("attempts") + 1})


def complete(jobs: DataFrame) -> DataFrame:
    """Adds superseded_by to failures of a key that was done later: the id of the first such job."""
    after = Window.partitionBy("dedupe_key").orderBy("id").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("state") == "done", F.col("id")), ignorenulls=True).over(after)
    return jobs.select("id", "dedupe_key", "state", following.alias("superseded_by")).where("state = 'failed'").drop("state")


def verdict(rate_limited: Column, retryable: Column) -> Column:
    """What becomes of a job that did not succeed."""
    return F.when(rate_limited & (F.col("parks") < MAX_PARKS), "park").when(retryable & (F.col("attempts") < MAX_ATTEMPTS), "retry").otherwise("fail")


def backoff(attempts: Column) -> Column:
    """Seconds until the next attempt: two to the power of the attempts, from 2 to 64."""
    return F.pow(F.lit(2), F.greatest(F.lit(1), F.least(attempts, F.lit(6)))).cast("long")


def park_delay(parks: Column) -> Column:
    return F.least(5 * F.pow(F.lit(2), F.least(parks, F.lit(4))), F.lit(60)).cast("long")


def purge(jobs: DataFrame, before: int, batch: int) -> DataFrame:
    """The oldest done jobs that a retention pass removes."""
    return jobs.where((F.col("state") == "done") & (F.col("updated_at") < before)).orderBy("updated_at", "id").limit(batch)


def depth(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("kind", "state").agg(F.count("*").alias("n"), F.count("last_error").alias("with_error"))


def debounce(events: DataFrame, key: str, time: str, quiet: int) -> DataFrame:
    """Bursts of each key's events: a gap of ``quiet`` seconds or more settles what came before it."""
    order = Window.partitionBy(key).orderBy(time, "event_id")
    gap = F.col(time) - F.lag(time).over(order)
    burst = F.sum(F.when(gap >= quiet, 1).otherwise(0)).over(order)
    return (
        events.withColumn("burst", burst)
        .groupBy(key, "burst")
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))
        .withColumn("settled", F.col("last") + quiet)
    )


def debounce_bounded(events: DataFrame, key: str, time: str, quiet: int, oldest: int) -> DataFrame:
    """Bursts as :func:`debounce`, but one that reaches the age ``oldest`` settles at once and the next event opens another.

    Where a burst is cut depends on where the one before was, so a burst that grows too old is
    folded in order; all others, found and settled by window functions, need no fold.
    """
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        out, first, last, n = [], None, None, 0
        name = rows[key].iloc[0]
        for at in rows[time].sort_values():
            if first is not None and at >= first + oldest:
                out.append((name, first, last, n, first + oldest, "age"))
                first = None
            if first is None:
                first, n = at, 0
            last, n = at, n + 1
        out.append((name, first, last, n, min(last + quiet, first + oldest), "quiet" if last + quiet <= first + oldest else "age"))
        return pd.DataFrame(out, columns=[key, "first", "last", "n", "settled", "reason"])

    order = Window.partitionBy(key).orderBy(time, "event_id")
    burst = F.sum(F.when(F.col(time) - F.lag(time).over(order) >= quiet, 1).otherwise(0)).over(order)
    rows = events.select(key, F.col(time).cast("long").alias(time), burst.alias("burst"))
    mine = Window.partitionBy(key, "burst")
    aged = rows.withColumn("old", F.max(time).over(mine) - F.min(time).over(mine) >= oldest)
    schema = f"{key} {dict(events.dtypes)[key]}, first long, last long, n long, settled long, reason string"
    folded = aged.where("old").groupBy(key, "burst").applyInPandas(fold, schema)
    young = aged.where("NOT old").groupBy(key, "burst").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n")).drop("burst")
    by_quiet = F.col("last") + quiet <= F.col("first") + oldest
    settled = young.withColumns({"settled": F.least(F.col("last") + quiet, F.col("first") + oldest), "reason": F.when(by_quiet, "quiet").otherwise("age")})
    return settled.unionByName(folded)

"""The job queue and the event stream, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables, with_views
from corvane.operators import queue
from corvane.queries import query

#: The time that counts as now.
NOW = 1_705_000_000


@query(with_views("SELECT kind, state, count(*) AS n, count(last_error) AS with_error FROM jobs GROUP BY kind, state", "jobs"))
def queue_depth(t: Tables) -> DataFrame:
    return queue.depth(t.jobs)


@query(
    with_views(
        """SELECT dedupe_key, max(id) AS id, CAST(max(priority) AS INTEGER) AS priority, max(not_before) AS not_before, arg_max(payload, id) AS payload,
        CASE WHEN arg_max(state, id) = 'failed' THEN 'pending' ELSE arg_max(state, id) END AS state, 0 AS attempts, 0 AS parks FROM jobs WHERE state <> 'done' GROUP BY dedupe_key""",
        "jobs",
    )
)
def enqueue_fold(t: Tables) -> DataFrame:
    return queue.enqueue(t.jobs)


@query(with_views(f"SELECT id, kind, dedupe_key, 'running' AS state, CAST(priority AS INTEGER) AS priority, CAST(attempts + 1 AS INTEGER) AS attempts FROM jobs WHERE state = 'pending' AND kind = 'scan' AND not_before <= {NOW} ORDER BY priority DESC, id DESC LIMIT 64", "jobs"))
def claim_lifo(t: Tables) -> DataFrame:
    return queue.claim(t.jobs, "scan", NOW, 64).select("id", "kind", "dedupe_key", "state", "priority", "attempts")


@query(
    with_views(
        """j AS (SELECT id, 'u' || regexp_extract(dedupe_key, '[0-9]+$') AS dedupe_key, state FROM jobs)
        SELECT id, dedupe_key, coalesce((SELECT min(d.id) FROM j d WHERE d.state = 'done' AND d.dedupe_key = f.dedupe_key AND d.id > f.id), -1) AS superseded_by FROM j f WHERE state = 'failed'""",
        "jobs",
    )
)
def complete_supersede(t: Tables) -> DataFrame:
    return queue.complete(t.jobs.withColumn("dedupe_key", F.concat(F.lit("u"), F.regexp_extract("dedupe_key", "[0-9]+$", 0)))).fillna(-1, ["superseded_by"])


@query(
    with_views(
        """SELECT id, CASE WHEN id % 2 = 0 AND parks < 20 THEN 'park' WHEN id % 3 <> 0 AND attempts < 3 THEN 'retry' ELSE 'fail' END AS verdict,
        CAST(pow(2, greatest(1, least(attempts, 6))) AS BIGINT) AS backoff_s, CAST(least(5 * pow(2, least(parks, 4)), 60) AS BIGINT) AS park_s FROM jobs WHERE state = 'failed'""",
        "jobs",
    )
)
def retry_verdict(t: Tables) -> DataFrame:
    failed = t.jobs.where("state = 'failed'")
    return failed.select("id", queue.verdict(F.col("id") % 2 == 0, F.col("id") % 3 != 0).alias("verdict"), queue.backoff(F.col("attempts")).alias("backoff_s"), queue.park_delay(F.col("parks")).alias("park_s"))


@query(with_views(f"SELECT id, updated_at FROM jobs WHERE state = 'done' AND updated_at < {NOW} ORDER BY updated_at, id LIMIT 500", "jobs"))
def retention_purge(t: Tables) -> DataFrame:
    return queue.purge(t.jobs, NOW, 500).select("id", "updated_at")


@query(with_views("SELECT id, last_error, greatest(0, 1710000000 - updated_at) AS age_s FROM jobs WHERE state = 'failed' ORDER BY updated_at DESC, id DESC LIMIT 1", "jobs"))
def last_failure(t: Tables) -> DataFrame:
    failed = t.jobs.where("state = 'failed'").orderBy(F.desc("updated_at"), F.desc("id")).limit(1)
    return failed.select("id", "last_error", F.greatest(F.lit(0), F.lit(1_710_000_000) - F.col("updated_at")).alias("age_s"))


_SECONDS = "e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events)"


def _seconds(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", F.unix_timestamp("ts").alias("secs"))


@query(
    f"""WITH {_SECONDS}, g AS (SELECT *, secs - lag(secs) OVER (PARTITION BY user_id ORDER BY secs, event_id) AS gap FROM e),
    b AS (SELECT *, sum(CASE WHEN gap >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY secs, event_id) AS burst FROM g)
    SELECT user_id, CAST(burst AS BIGINT) AS burst, min(secs) AS first, max(secs) AS last, count(*) AS n, max(secs) + 21600 AS settled FROM b GROUP BY user_id, burst"""
)
def debounce_settled(t: Tables) -> DataFrame:
    return queue.debounce(_seconds(t), "user_id", "secs", 21600)


@query()
def debounce_bounded(t: Tables) -> DataFrame:
    return queue.debounce_bounded(_seconds(t), "user_id", "secs", 21600, 6 * 21600)


@query(
    """WITH l AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 1024)
    SELECT event_type, count(*) AS n, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(max(value), 6) AS worst FROM l GROUP BY event_type"""
)
def stage_latency_percentiles(t: Tables) -> DataFrame:
    last = t.events.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))).where("n <= 1024")
    return last.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)"), 6).alias("p50"),
        F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)"), 6).alias("p95"),
        F.round(F.max("value"), 6).alias("worst"),
    )

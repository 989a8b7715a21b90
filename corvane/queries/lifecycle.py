"""Transitions, removals, cursors and resolved places over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables, with_views
from corvane.operators import lifecycle, provenance, queue
from corvane.queries import query
from corvane.queries.jobs import NOW

_JOB = "id, state, not_before, CAST(attempts AS INTEGER) AS attempts, CAST(parks AS INTEGER) AS parks, last_error, updated_at"


@query(
    with_views(
        f"""SELECT id, 'pending' AS state, {NOW} + CAST(least(5 * pow(2, least(parks, 4)), 60) AS BIGINT) AS not_before, CAST(greatest(attempts - 1, 0) AS INTEGER) AS attempts,
        CAST(parks + 1 AS INTEGER) AS parks, last_error, CAST({NOW} AS BIGINT) AS updated_at FROM jobs WHERE state = 'running'""",
        "jobs",
    )
)
def jobs_parked(t: Tables) -> DataFrame:
    jobs = t.jobs.where("state = 'running'")
    return lifecycle.park(jobs, NOW, queue.park_delay(F.col("parks"))).select("id", "state", "not_before", "attempts", "parks", "last_error", "updated_at")


@query(
    with_views(
        f"""SELECT id, 'pending' AS state, {NOW} + CAST(pow(2, greatest(1, least(attempts, 6))) AS BIGINT) AS not_before, left('again: ' || payload, 2000) AS last_error,
        CAST({NOW} AS BIGINT) AS updated_at FROM jobs WHERE state = 'running'""",
        "jobs",
    )
)
def jobs_retried(t: Tables) -> DataFrame:
    jobs = t.jobs.where("state = 'running'")
    return lifecycle.retry(jobs, NOW, queue.backoff(F.col("attempts")), F.concat(F.lit("again: "), "payload")).select("id", "state", "not_before", "last_error", "updated_at")


def _released_sql(reason: str, attempts: str) -> str:
    running = lambda c, v: f"CASE WHEN state = 'running' THEN {v} ELSE {c} END AS {c}"
    return f"""SELECT id, {running('state', "'pending'")}, CAST(CASE WHEN state = 'running' THEN {attempts} ELSE attempts END AS INTEGER) AS attempts, {running('last_error', f"'{reason}'")},
        CAST(CASE WHEN state = 'running' THEN {NOW} ELSE updated_at END AS BIGINT) AS updated_at FROM jobs"""


@query(with_views(_released_sql("released at shutdown", "greatest(attempts - 1, 0)"), "jobs"))
def jobs_released(t: Tables) -> DataFrame:
    return lifecycle.release(t.jobs, NOW, "released at shutdown", refund=True).select("id", "state", "attempts", "last_error", "updated_at")


@query(with_views(_released_sql("requeued at boot", "attempts"), "jobs"))
def jobs_requeued(t: Tables) -> DataFrame:
    return lifecycle.release(t.jobs, NOW, "requeued at boot", refund=False).select("id", "state", "attempts", "last_error", "updated_at")


@query(with_views("SELECT kind, count(*) AS n FROM jobs WHERE state IN ('pending', 'running') GROUP BY kind", "jobs"))
def jobs_remaining(t: Tables) -> DataFrame:
    return lifecycle.remaining(t.jobs)


@query(with_views("SELECT identity, root_path, path, blob_sha FROM locations WHERE root_path IS NOT NULL", "locations"))
def provenance_chain(t: Tables) -> DataFrame:
    places = t.locations.where("root_path IS NOT NULL")
    repos = places.select(F.xxhash64("identity").alias("repo_id"), "identity").distinct()
    worktrees = places.select(F.xxhash64("root_path").alias("worktree_id"), F.xxhash64("identity").alias("repo_id"), "root_path").distinct()
    files = places.select(F.xxhash64("root_path").alias("worktree_id"), "path", "blob_sha")
    return lifecycle.chain(files, worktrees, repos).select("identity", "root_path", "path", "blob_sha")


# A conversation is anchored at the repository and worktree of the document of its number, if there is one.
_PLACES = """live AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_sha ORDER BY identity, root_path, path) AS n FROM locations) WHERE n = 1),
    anchors AS (SELECT * FROM (SELECT sha256(body) AS blob_sha, identity, root_path, row_number() OVER (PARTITION BY sha256(body) ORDER BY identity NULLS LAST, root_path NULLS LAST) AS n
        FROM turns JOIN locations ON conv_id = element_id) WHERE n = 1),
    placed AS (SELECT e.id, e.kind, coalesce(l.identity, a.identity) AS identity, coalesce(l.root_path, a.root_path) AS root_path, l.path FROM elements e
        LEFT JOIN live l ON l.blob_sha = e.raw_hash LEFT JOIN anchors a ON a.blob_sha = e.raw_hash)"""


def _placed(t: Tables, scoped: bool) -> DataFrame:
    turns = t.turns.select("conv_id", F.sha2("body", 256).alias("blob_sha"))
    anchors = lifecycle.anchored(turns, t.locations.select(F.col("element_id").alias("conv_id"), "identity", "root_path"))
    hits = t.elements.select("id", "kind", "raw_hash")
    return lifecycle.resolved(hits, provenance.representative(t.locations), anchors, scoped=scoped).select("id", "kind", "identity", "root_path", "path")


@query(with_views(f"{_PLACES} SELECT * FROM placed", "turns", "elements", "locations"))
def resolved_places(t: Tables) -> DataFrame:
    return _placed(t, scoped=False)


@query(with_views(f"{_PLACES} SELECT * FROM placed WHERE coalesce(identity, root_path, path) IS NOT NULL", "turns", "elements", "locations"))
def guarded_places(t: Tables) -> DataFrame:
    return _placed(t, scoped=True)


@query(
    with_views(
        """a AS (SELECT id, address, substr(address, 4) AS rest FROM elements WHERE starts_with(address, 'el:')),
        k AS (SELECT DISTINCT identity FROM locations UNION SELECT DISTINCT root_path FROM locations),
        m AS (SELECT id, address, rest, identity, row_number() OVER (PARTITION BY id ORDER BY length(identity) DESC) AS n FROM a JOIN k ON rest = identity OR starts_with(rest, identity || '/'))
        SELECT id, address, identity, substr(rest, length(identity) + 2) AS tail FROM m WHERE n = 1""",
        "turns",
        "elements",
        "locations",
    )
)
def address_identities(t: Tables) -> DataFrame:
    known = t.locations.select("identity").union(t.locations.select("root_path"))
    rows = t.elements.where(F.col("address").startswith("el:")).select("id", "address")
    return lifecycle.split_address(rows, known, F.substring("address", 4, 1 << 30))


@query(
    with_views(
        """r AS (SELECT root_path, identity, count(*) AS files FROM locations GROUP BY 1, 2),
        h AS (SELECT blob_sha, min(root_path) AS root_path FROM locations GROUP BY blob_sha HAVING count(DISTINCT root_path) = 1)
        SELECT root_path, identity, files, count(*) OVER (PARTITION BY identity) = 1 AS repo_removed, (SELECT count(*) FROM h WHERE h.root_path = r.root_path) AS orphans FROM r""",
        "locations",
    )
)
def root_removals(t: Tables) -> DataFrame:
    return lifecycle.root_removals(t.locations)


@query(
    with_views(
        """c AS (SELECT DISTINCT conv_id, sha256(body) AS h FROM turns), s AS (SELECT h, count(*) > 1 AS shared FROM c GROUP BY h),
        k AS (SELECT conv_id, count(*) FILTER (NOT shared) AS freed, count(*) FILTER (shared) AS spared FROM c JOIN s USING (h) GROUP BY conv_id)
        SELECT conv_id, n AS turns, freed, spared FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id) JOIN k USING (conv_id)""",
        "turns",
    )
)
def conversation_removals(t: Tables) -> DataFrame:
    return lifecycle.conversation_removals(t.turns.select("conv_id", F.sha2("body", 256).alias("blob_sha")))


@query(
    with_views(
        """c AS (SELECT 'h' || (conv_id % 3) AS harness, conv_id // 2 AS session, conv_id AS conversation, count(*) AS position FROM turns GROUP BY conv_id),
        s AS (SELECT * FROM c WHERE conversation % 2 = 0), o AS (SELECT * FROM c WHERE conversation % 4 <> 0)
        SELECT coalesce(s.harness, o.harness) AS harness, coalesce(s.session, o.session) AS session, coalesce(s.conversation, o.conversation) AS conversation,
            CASE WHEN o.position IS NULL OR coalesce(s.conversation <> o.conversation, FALSE) THEN s.position ELSE greatest(o.position, coalesce(s.position, o.position)) END AS position,
            coalesce(s.conversation <> o.conversation, FALSE) AS refused
        FROM s FULL JOIN o ON s.harness = o.harness AND s.session = o.session""",
        "turns",
    )
)
def cursor_commits(t: Tables) -> DataFrame:
    c = t.turns.groupBy(F.col("conv_id").alias("conversation")).agg(F.count("*").alias("position"))
    c = c.select(F.concat(F.lit("h"), F.col("conversation") % 3).alias("harness"), F.expr("conversation div 2").alias("session"), "conversation", "position")
    return lifecycle.commit_cursors(c.where("conversation % 2 = 0"), c.where("conversation % 4 <> 0"))


@query(
    """WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source = 'src0')
    SELECT h, 'a' AS side FROM (SELECT h FROM a EXCEPT SELECT h FROM b) UNION ALL SELECT h, 'b' FROM (SELECT h FROM b EXCEPT SELECT h FROM a)"""
)
def hash_difference(t: Tables) -> DataFrame:
    of = lambda where: t.documents.where(where).select(F.sha2("text", 256).alias("h"))
    return lifecycle.symmetric_difference(of("lang = 'en'"), of("source = 'src0'"))


@query("SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM embeddings GROUP BY label")
def vectors_per_label(t: Tables) -> DataFrame:
    counted = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))  # one row a label


@query(with_views("SELECT identity, root_path, count(*) AS files, max(element_id) AS newest FROM locations GROUP BY 1, 2", "locations"))
def worktree_files(t: Tables) -> DataFrame:
    return t.locations.groupBy("identity", "root_path").agg(F.count("*").alias("files"), F.max("element_id").alias("newest")).orderBy(F.desc("newest"), "root_path")


@query(
    with_views(
        """f AS (SELECT conv_id, max(turn_no) AS from_turn FROM turns GROUP BY conv_id)
        SELECT conv_id, max(turn_no) AS turn_no, arg_max(turn_class, turn_no) AS turn_class FROM turns JOIN f USING (conv_id) WHERE turn_no < from_turn GROUP BY conv_id""",
        "turns",
    )
)
def append_seeds(t: Tables) -> DataFrame:
    return lifecycle.seed_turns(t.turns, t.turns.groupBy("conv_id").agg(F.max("turn_no").alias("from_turn")))


@query(
    """WITH s AS (SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, CAST(floor(epoch(max(ts))) AS BIGINT) AS last FROM events GROUP BY user_id)
    SELECT user_id, started, last, started <= 1704326400 AS exists, started <= 1704326400 AND 1704326400 <= last AS live FROM s"""
)
def playhead(t: Tables) -> DataFrame:
    spans = t.events.groupBy("user_id").agg(F.unix_timestamp(F.min("ts")).alias("started"), F.unix_timestamp(F.max("ts")).alias("last"))
    return lifecycle.at_playhead(spans, F.lit(1704326400))


@query(with_views("SELECT conv_id, turn_no, role, source FROM turns WHERE role IN ('human') AND contains(lower(concat_ws(chr(10), name, body)), 'the')", "turns"))
def atlas_matches(t: Tables) -> DataFrame:
    return lifecycle.matching(t.turns, {"role": ["human"], "source": []}, " The ", ("name", "body")).select("conv_id", "turn_no", "role", "source")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def utc_texts(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.unix_timestamp("ts").alias("seconds"))

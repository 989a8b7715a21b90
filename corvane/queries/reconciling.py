"""Reconciliation, polling, reports and the remaining read operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables, with_views
from corvane.operators import lexical, queue, reconcile
from corvane.operators.lexical import SearchFilters
from corvane.queries import query
from corvane.queries.search import _scored_sql


@query(
    """WITH d AS (SELECT DISTINCT source || '/' || lang AS root FROM documents WHERE doc_id % 3 = 0), a AS (SELECT DISTINCT source || '/' || lang AS root FROM documents WHERE doc_id % 3 = 1)
    SELECT root, 'add' AS action FROM d WHERE root NOT IN (SELECT root FROM a) UNION ALL SELECT root, 'remove' FROM a WHERE root NOT IN (SELECT root FROM d)"""
)
def watched_roots(t: Tables) -> DataFrame:
    root = F.concat_ws("/", "source", "lang").alias("root")
    return reconcile.set_difference(t.documents.where("doc_id % 3 = 0").select(root), t.documents.where("doc_id % 3 = 1").select(root), "root")


@query(
    """WITH n AS (SELECT user_id, event_type <> 'error' AS seen, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id FROM n WHERE n <= 2 GROUP BY user_id HAVING count(*) FILTER (NOT seen) = 2"""
)
def missed_twice(t: Tables) -> DataFrame:
    return reconcile.missed(t.events.withColumn("seen", F.col("event_type") != "error"), "user_id", "event_id", "seen")


@query(
    """WITH d AS (SELECT user_id, max(event_type) AS text FROM events WHERE event_id % 3 = 0 GROUP BY 1), a AS (SELECT user_id, max(event_type) AS text, user_id % 2 = 0 AS acked FROM events WHERE event_id % 5 = 0 GROUP BY 1)
    SELECT d.user_id, d.text, coalesce(d.text = a.text AND acked, FALSE) AS acked FROM d LEFT JOIN a USING (user_id)"""
)
def synced_messages(t: Tables) -> DataFrame:
    desired = t.events.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("event_type").alias("text"))
    actual = t.events.where("event_id % 5 = 0").groupBy("user_id").agg(F.max("event_type").alias("text")).withColumn("acked", F.col("user_id") % 2 == 0)
    return reconcile.sync_messages(desired, actual, "user_id")


@query("WITH r AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS last FROM events) SELECT event_id FROM r WHERE coalesce(last < 1705000000 - 86400, TRUE)")
def due_checks(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 > 0, F.unix_timestamp("ts")).alias("last"))
    return reconcile.due(rows, "last", 1_705_000_000, 86_400).select("event_id")


@query(
    with_views(
        """p AS (SELECT DISTINCT root_path AS path FROM locations WHERE element_id % 2 = 0 UNION SELECT DISTINCT identity FROM locations WHERE identity < 'src14')
        SELECT path FROM p WHERE NOT EXISTS (SELECT 1 FROM p a WHERE starts_with(p.path, a.path || '/'))""",
        "locations",
    )
)
def settled_directories(t: Tables) -> DataFrame:
    places = t.locations
    paths = places.where("element_id % 2 = 0").select(F.col("root_path").alias("path")).union(places.where("identity < 'src14'").select("identity"))
    return reconcile.topmost(paths)


@query(
    with_views(
        """h AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id)
        SELECT conv_id, CAST(CASE WHEN n > 6 THEN 0 WHEN conv_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS lane FROM h""",
        "turns",
    )
)
def poll_lanes(t: Tables) -> DataFrame:
    heads = t.turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    return reconcile.poll_order(heads, F.col("n") > 6, F.col("conv_id") % 3 != 0).select("conv_id", "lane")


@query(
    with_views(
        """m AS (SELECT conv_id, turn_no FROM turns WHERE role = 'human')
        SELECT 1000 * conv_id + turn_no AS id, (SELECT m.turn_no FROM m WHERE m.conv_id = t.conv_id ORDER BY abs(m.turn_no - t.turn_no), m.turn_no LIMIT 1) AS mark
        FROM turns t WHERE role <> 'human' AND conv_id IN (SELECT conv_id FROM m)""",
        "turns",
    )
)
def nearest_turn(t: Tables) -> DataFrame:
    points = t.turns.where("role <> 'human'").select("conv_id", "turn_no", (1000 * F.col("conv_id") + F.col("turn_no")).alias("id"))
    return reconcile.nearest(points, t.turns.where("role = 'human'"), "conv_id", "turn_no").where("mark IS NOT NULL")


@query(
    """WITH RECURSIVE e AS (SELECT doc_id AS id, CASE WHEN doc_id > 0 AND doc_id % 7 > 0 THEN doc_id // 7 END AS parent_id FROM documents),
    up AS (SELECT id, parent_id AS ancestor, 1 AS distance FROM e WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, e.parent_id, distance + 1 FROM up JOIN e ON up.ancestor = e.id WHERE e.parent_id IS NOT NULL)
    SELECT * FROM up"""
)
def element_ancestors(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return reconcile.ancestors(t.documents.select(d.alias("id"), F.when((d > 0) & (d % 7 > 0), F.floor(d / 7)).alias("parent_id")))


@query(
    with_views(
        _scored_sql("zebra crossing")
        + """SELECT CASE WHEN (SELECT count(*) FROM locations WHERE identity = 'src1') = 0 THEN 'scope_unmatched' WHEN (SELECT count(*) FROM locations WHERE path LIKE 'en/%') = 0 THEN 'path_unmatched'
        WHEN (SELECT count(*) FROM scored WHERE score < 0.5) > 0 THEN 'below_floor' WHEN (SELECT count(*) FROM scored WHERE hidden) > 0 THEN 'retrieval_hidden' ELSE 'no_match' END AS reason""",
        "turns",
        "elements",
        "locations",
    )
)
def empty_because_probe(t: Tables) -> DataFrame:
    found = lexical.scored(t.elements, "zebra crossing").agg(F.count_if(F.col("score") < 0.5).alias("below"), F.count_if("hidden").alias("hidden"))
    places = t.locations.agg(F.count_if(F.col("identity") == "src1").alias("scope"), F.count_if(F.col("path").like("en/%")).alias("paths"))
    return found.crossJoin(F.broadcast(places)).select(reconcile.diagnosis(F.col("below"), F.col("scope"), F.col("paths"), F.col("hidden")).alias("reason"))  # one row each


@query(
    """WITH o AS (SELECT vec_id AS node, label AS cluster FROM embeddings), n AS (SELECT vec_id AS node, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS cluster FROM embeddings),
    p AS (SELECT o.cluster AS old, n.cluster AS new, count(*) AS n FROM o JOIN n USING (node) GROUP BY 1, 2), so AS (SELECT cluster, count(*) AS c FROM o GROUP BY 1), sn AS (SELECT cluster, count(*) AS c FROM n GROUP BY 1),
    j AS (SELECT old, new, round(n / (so.c + sn.c - n), 6) AS jaccard FROM p JOIN so ON old = so.cluster JOIN sn ON new = sn.cluster),
    r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY jaccard DESC, new) AS x, row_number() OVER (PARTITION BY new ORDER BY jaccard DESC, old) AS y FROM j WHERE jaccard >= 0.3)
    SELECT old, new, jaccard FROM r WHERE x = 1 AND y = 1"""
)
def stable_clusters(t: Tables) -> DataFrame:
    old = t.embeddings.select(F.col("vec_id").alias("node"), F.col("label").alias("cluster"))
    shifted = (F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10
    return reconcile.matched_clusters(old, t.embeddings.select(F.col("vec_id").alias("node"), shifted.alias("cluster")))


@query(with_views(_scored_sql("that the", "kind = 'turn'") + "SELECT best.id, score, t.role, t.source FROM best JOIN turns t ON t.address = best.address WHERE NOT hidden", "turns", "elements"))
def attached_agents(t: Tables) -> DataFrame:
    found = lexical.scored(t.elements, "that the", SearchFilters(source="conversation")).where(~F.col("hidden"))
    return found.join(t.turns.select("address", "role", "source"), "address").select("id", "score", "role", "source")


@query(
    with_views(
        """SELECT 'queue' AS part, kind || '/' || state AS name, count(*) AS n FROM jobs GROUP BY 2 UNION ALL SELECT 'roots', identity, count(*) FROM locations GROUP BY 2
        UNION ALL SELECT 'failures', 'total', count(*) FROM jobs WHERE state = 'failed'""",
        "jobs",
        "locations",
    )
)
def status_report(t: Tables) -> DataFrame:
    depth = queue.depth(t.jobs).select(F.lit("queue").alias("part"), F.concat_ws("/", "kind", "state").alias("name"), "n")
    roots = t.locations.groupBy("identity").agg(F.count("*").alias("n")).select(F.lit("roots").alias("part"), F.col("identity").alias("name"), "n")
    failures = t.jobs.where("state = 'failed'").agg(F.count("*").alias("n")).select(F.lit("failures").alias("part"), F.lit("total").alias("name"), "n")
    return depth.unionAll(roots).unionAll(failures)


@query(
    with_views(
        """c AS (SELECT conv_id, count(*) FILTER (turn_class = 'work') AS n_work, count(*) AS n_turns FROM turns GROUP BY conv_id)
        SELECT conv_id, n_work, n_turns FROM c ORDER BY n_work DESC, n_turns DESC, conv_id LIMIT 15""",
        "turns",
    )
)
def longest_sessions(t: Tables) -> DataFrame:
    counts = t.turns.groupBy("conv_id").agg(F.count_if(F.col("turn_class") == "work").alias("n_work"), F.count("*").alias("n_turns"))
    return counts.orderBy(F.desc("n_work"), F.desc("n_turns"), "conv_id").limit(15)


@query(
    """WITH u AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)
    SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS models FROM u GROUP BY user_id"""
)
def models_never_forgotten(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(listed, ",").alias("models"))


@query(
    """WITH e AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM e)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS n, min(first) AS first_seen, max(last) AS last_seen, max(event_type) FILTER (k = 1) AS mode FROM r GROUP BY user_id"""
)
def seats(t: Tables) -> DataFrame:
    by_type = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))
    return by_type.withColumn("k", k).groupBy("user_id").agg(
        F.sum("n").alias("n"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.max(F.when(F.col("k") == 1, F.col("event_type"))).alias("mode")
    )

"""Vector search for elements, fused and balanced hits, and upkeep over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables, with_views
from corvane.operators import elements, hybrid, upkeep
from corvane.queries import query
from corvane.queries.search import _COS, _asked

# Documents as elements of three parsers' versions, every fourth a file and some others its children; vectors of their
# texts or of summaries of them, which are the texts with a mark.
_ELEMENTS_SQL = """e AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'file' ELSE 'section' END AS kind, sha256(text) AS blob_sha, 'v' || (doc_id % 3) AS parser_version, sha256(text) AS raw_hash,
        CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN doc_id - doc_id % 4 END AS parent_id, lang AS schema FROM documents),
    s AS (SELECT sha256(text) AS raw_hash, sha256(text || '!') AS text_hash, lang AS model, n_chars AS created FROM documents WHERE doc_id % 2 = 0),
    v AS (SELECT vec_id AS vector_id, CASE WHEN vec_id % 3 = 0 THEN 'smart' ELSE 'raw' END AS source_kind, CASE WHEN vec_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS source_hash, vec_id % 2 AS chunk_no
        FROM embeddings JOIN documents ON doc_id = vec_id)"""

_ADMITTED_SQL = f"""{_COS}, {_ELEMENTS_SQL},
    cur AS (SELECT * FROM e WHERE parser_version = 'v2' OR blob_sha NOT IN (SELECT blob_sha FROM e WHERE parser_version = 'v2')),
    s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY created, model, raw_hash) AS n FROM s) WHERE n = 1),
    c AS (SELECT id, kind, blob_sha, cur.raw_hash, v.* FROM cur JOIN v ON source_hash = raw_hash AND source_kind = 'raw' WHERE kind <> 'file' OR id NOT IN (SELECT parent_id FROM cur WHERE parent_id IS NOT NULL)
        UNION ALL SELECT id, kind, blob_sha, cur.raw_hash, v.* FROM cur JOIN s1 USING (raw_hash) JOIN v ON source_hash = text_hash AND source_kind = 'smart'),
    near AS (SELECT c.*, score FROM c JOIN cos ON vec_id = vector_id)"""


def _page_sql(where: str, limit: int) -> str:
    return f"""{_ADMITTED_SQL},
    one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source_kind, chunk_no, vector_id) AS n FROM near WHERE {where}) WHERE n = 1),
    alone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY score DESC, id) AS m FROM one) WHERE m = 1),
    page AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM alone ORDER BY score DESC, id LIMIT {limit}),
    standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY blob_sha ORDER BY identity, root_path, path) AS p FROM locations) WHERE p = 1)
    SELECT id, kind, score, source_kind, identity, root_path, path, rank FROM page LEFT JOIN standing USING (blob_sha)"""


def _tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, text = F.col("doc_id"), F.col("text")
    sha, loud = F.sha2(text, 256), F.sha2(F.concat(text, F.lit("!")), 256)
    every = t.documents.select(
        d.alias("id"), F.when(d % 4 == 0, "file").otherwise("section").alias("kind"), sha.alias("blob_sha"), F.concat(F.lit("v"), d % 3).alias("parser_version"), sha.alias("raw_hash"),
        F.when((d % 4 != 0) & (d % 3 == 0), d - d % 4).alias("parent_id"), F.col("lang").alias("schema"),
    )
    summaries = t.documents.where(d % 2 == 0).select(sha.alias("raw_hash"), loud.alias("text_hash"), F.col("lang").alias("model"), F.col("n_chars").alias("created"))
    smart = F.col("vec_id") % 3 == 0
    held = t.embeddings.join(t.documents.select(d.alias("vec_id"), sha.alias("sha"), loud.alias("loud")), "vec_id")
    vectors = held.select(
        F.col("vec_id").alias("vector_id"), F.when(smart, elements.SMART).otherwise(elements.RAW).alias("source_kind"), F.when(smart, F.col("loud")).otherwise(F.col("sha")).alias("source_hash"),
        (F.col("vec_id") % 2).alias("chunk_no"), "embedding",
    )
    return vectors, every, summaries


def _found(t: Tables, rule: elements.Admission, limit: int, min_score: float | None = None) -> DataFrame:
    return elements.search(*_tables(t), t.locations, _asked(t), rule, limit, min_score)


@query(with_views(_page_sql("TRUE", 60), "locations"))
def element_search(t: Tables) -> DataFrame:
    return _found(t, elements.Admission("v2"), 60)


@query(with_views(_page_sql("kind = 'section' AND source_kind = 'smart' AND id IN (SELECT id FROM e WHERE schema = 'en')", 25), "locations"))
def element_search_smart(t: Tables) -> DataFrame:
    return _found(t, elements.Admission("v2", kinds=("section",), schema="en", source_kind=elements.SMART), 25)


@query(with_views(_page_sql("score >= 0.1", 100), "locations"))
def element_search_floor(t: Tables) -> DataFrame:
    return _found(t, elements.Admission("v2"), 100, 0.1)


# Hits of two legs, of which a place is named by address, worktree, path and span; conversations' turns have neither worktree nor path.
_LEGS_SQL = """h AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'conv:' || (user_id % 7) || '#t' || (event_id % 5) ELSE 'el:' || (user_id % 9) END AS address, CASE WHEN event_id % 3 <> 0 THEN 'w' || (event_id % 2) END AS worktree,
        CASE WHEN event_id % 3 <> 0 THEN 'p' || (user_id % 9) END AS path, event_id % 4 AS span, CASE WHEN event_id % 3 = 0 THEN user_id % 7 END AS conv_id, round(least(1.0, value / 100), 6) AS score, event_id FROM events),
    lex AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM h WHERE event_id % 2 = 0), sem AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM h WHERE event_id % 2 = 1),
    l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, worktree, path, span ORDER BY rank) AS n FROM lex WHERE rank <= 60) WHERE n = 1),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address, worktree, path, span ORDER BY rank) AS n FROM sem WHERE rank <= 60) WHERE n = 1),
    f AS (SELECT coalesce(l.address, r.address) AS address, coalesce(l.worktree, r.worktree) AS worktree, coalesce(l.path, r.path) AS path, coalesce(l.span, r.span) AS span,
        CASE WHEN r.rank IS NULL THEN 'lexical' WHEN l.rank IS NULL THEN 'semantic' ELSE 'both' END AS channel,
        round(CASE WHEN l.rank IS NOT NULL AND r.rank IS NOT NULL THEN least(1.0, greatest(l.score, r.score) + 0.1 * greatest(least(l.score, r.score), 0.0)) ELSE coalesce(l.score, r.score) END, 6) AS score, l.rank AS lr, r.rank AS rr
        FROM l FULL JOIN r ON l.address = r.address AND l.worktree IS NOT DISTINCT FROM r.worktree AND l.path IS NOT DISTINCT FROM r.path AND l.span = r.span),
    fused AS (SELECT address, worktree, path, span, channel, score, row_number() OVER (ORDER BY score DESC, lr NULLS LAST, rr NULLS LAST) AS rank FROM f)"""


def _fused_hits(t: Tables) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    talk = i % 3 == 0
    hits = t.events.select(
        F.when(talk, F.concat(F.lit("conv:"), u % 7, F.lit("#t"), i % 5)).otherwise(F.concat(F.lit("el:"), u % 9)).alias("address"), F.when(~talk, F.concat(F.lit("w"), i % 2)).alias("worktree"),
        F.when(~talk, F.concat(F.lit("p"), u % 9)).alias("path"), (i % 4).alias("span"), F.round(F.least(F.lit(1.0), F.col("value") / 100), 6).alias("score"), i,
    )
    order = [F.desc("score"), F.col("event_id")]
    leg = lambda rows: rows.orderBy(*order).limit(60).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return hybrid.fuse_hits(leg(hits.where(i % 2 == 0)), leg(hits.where(i % 2 == 1)), ["address", "worktree", "path", "span"])


@query(f"WITH {_LEGS_SQL} SELECT * FROM fused")
def fused_hits(t: Tables) -> DataFrame:
    return _fused_hits(t)


@query(
    f"""WITH {_LEGS_SQL}, k AS (SELECT *, CASE WHEN starts_with(address, 'conv:') THEN split_part(address, '#', 1) END AS conv, CASE WHEN NOT starts_with(address, 'conv:') THEN worktree || '/' || path END AS file FROM fused),
    n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(conv, file) ORDER BY rank) AS n, (SELECT count(DISTINCT conv) FROM k) AS convs, (SELECT count(DISTINCT file) FROM k) AS files FROM k),
    m AS (SELECT *, n > CASE WHEN conv IS NULL THEN 1 ELSE 2 END AND score < 1.0 AND CASE WHEN conv IS NULL THEN files > 1 ELSE convs > 1 END AS moved FROM n),
    d AS (SELECT *, count(*) FILTER (moved AND rank <= 30) OVER (PARTITION BY coalesce(conv, file)) AS below FROM m)
    SELECT address, span, channel, score, moved, CASE WHEN n = 1 AND below > 0 THEN below END AS moved_down, row_number() OVER (ORDER BY moved, rank) AS rank FROM d"""
)
def balanced_hits(t: Tables) -> DataFrame:
    talk = F.col("address").startswith("conv:")
    rows = _fused_hits(t).withColumns({"conv": F.when(talk, F.split("address", "#")[0]), "file": F.when(~talk, F.concat("worktree", F.lit("/"), "path"))})
    return hybrid.balance_hits(rows, "conv", "file", 30).select("address", "span", "channel", "score", "moved", "moved_down", "rank")


@query(f"WITH {_ELEMENTS_SQL} SELECT min(id) AS id, raw_hash FROM e WHERE raw_hash NOT IN (SELECT raw_hash FROM s WHERE model = 'en') GROUP BY raw_hash")
def missing_summaries(t: Tables) -> DataFrame:
    _, every, summaries = _tables(t)
    return upkeep.missing_summaries(every, summaries, "en")


@query(f"WITH {_ELEMENTS_SQL}, w AS (SELECT text_hash AS source_hash FROM s UNION ALL SELECT raw_hash FROM e) SELECT DISTINCT source_hash FROM w WHERE source_hash IN (SELECT source_hash FROM v WHERE source_kind = 'smart' AND vector_id % 5 <> 0)")
def vectors_at_hand(t: Tables) -> DataFrame:
    vectors, every, summaries = _tables(t)
    wanted = summaries.select(F.col("text_hash").alias("source_hash")).unionAll(every.select("raw_hash"))
    return upkeep.vectors_at_hand(wanted, vectors.withColumn("model", F.when(F.col("vector_id") % 5 != 0, "m1").otherwise("m2")), "m1", elements.SMART)


@query(with_views(f"{_ELEMENTS_SQL} SELECT DISTINCT root_path FROM locations WHERE blob_sha IN (SELECT blob_sha FROM e WHERE parser_version <> 'v2') AND blob_sha NOT IN (SELECT blob_sha FROM e WHERE parser_version = 'v2')", "locations"))
def outdated_roots(t: Tables) -> DataFrame:
    return upkeep.outdated_roots(t.locations, _tables(t)[1], "v2")


@query(
    f"""WITH {_ELEMENTS_SQL}, kept AS (SELECT * FROM e WHERE id % 5 <> 1), h AS (SELECT DISTINCT source_hash AS hash FROM v)
    SELECT hash, hash IN (SELECT raw_hash FROM kept) AS by_element, hash IN (SELECT text_hash FROM s WHERE raw_hash IN (SELECT raw_hash FROM kept)) AS by_summary FROM h"""
)
def referred_hashes(t: Tables) -> DataFrame:
    vectors, every, summaries = _tables(t)
    return upkeep.referred(vectors.select(F.col("source_hash").alias("hash")), every.where("id % 5 <> 1"), summaries)


@query(
    with_views(
        """sent AS (SELECT conv_id, count(*) + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM turns GROUP BY conv_id), held AS (SELECT conv_id, count(*) AS stored, max(turn_no) AS last_at FROM turns WHERE conv_id % 7 <> 2 GROUP BY conv_id)
        SELECT conv_id, n AS sent, coalesce(stored, 0) AS stored, last_at, coalesce(stored, 0) >= n AS arrived FROM sent LEFT JOIN held USING (conv_id)""",
        "turns",
    )
)
def delivered_conversations(t: Tables) -> DataFrame:
    sent = t.turns.groupBy("conv_id").agg((F.count("*") + F.when(F.col("conv_id") % 3 == 0, 1).otherwise(0)).alias("n"))
    return upkeep.deliveries(sent, t.turns.where("conv_id % 7 <> 2").select("conv_id", F.col("turn_no").alias("at")))


@query(
    with_views(
        """w AS (SELECT conv_id, sha256(body) AS h, (length(body) + turn_no) % 50 AS s_at, (length(body) * 3 + conv_id) % 60 AS v_at FROM turns),
        fresh AS (SELECT h FROM w WHERE s_at > 44 UNION SELECT h FROM w WHERE v_at > 55) SELECT DISTINCT conv_id FROM w WHERE h IN (SELECT h FROM fresh)""",
        "turns",
    )
)
def late_conversations(t: Tables) -> DataFrame:
    n = F.length("body")
    rows = t.turns.select("conv_id", F.sha2("body", 256).alias("raw_hash"), ((n + F.col("turn_no")) % 50).alias("s_at"), ((n * 3 + F.col("conv_id")) % 60).alias("v_at"))
    vectors = rows.select(F.col("raw_hash").alias("source_hash"), (F.col("v_at") - 11).alias("at"))
    return upkeep.late_enrichment(rows.select("conv_id", "raw_hash"), rows.select("raw_hash", F.col("s_at").alias("at")), vectors, 44)


# The directory as it is now lacks some files, has others' texts in some and some that were not recorded.
_LISTED_SQL = """now AS (SELECT path, CASE WHEN element_id % 4 = 1 THEN sha256(path) ELSE blob_sha END AS blob_sha FROM locations WHERE identity = 'src1' AND element_id % 7 <> 3), then_ AS (SELECT path, blob_sha FROM locations WHERE identity = 'src1' AND element_id % 5 <> 2),
    a AS (SELECT path, n.blob_sha, b.blob_sha AS was FROM (SELECT * FROM now WHERE starts_with(path, 'en/')) n FULL JOIN (SELECT * FROM then_ WHERE starts_with(path, 'en/')) b USING (path)),
    c AS (SELECT path, blob_sha, was, CASE WHEN blob_sha IS NULL THEN 'removed' WHEN was IS NULL THEN 'new' WHEN blob_sha <> was THEN 'edited' END AS change FROM a)"""


def _relisted(t: Tables) -> tuple[DataFrame, DataFrame]:
    mine = t.locations.where("identity = 'src1'")
    now = mine.where("element_id % 7 <> 3").select("path", F.when(F.col("element_id") % 4 == 1, F.sha2("path", 256)).otherwise(F.col("blob_sha")).alias("blob_sha"))
    parsed = t.locations.where("element_id % 3 = 0").select("blob_sha")
    return upkeep.relisted("en", now, mine.where("element_id % 5 <> 2").select("path", "blob_sha"), parsed)


@query(
    with_views(
        f"""{_LISTED_SQL} SELECT path, coalesce(blob_sha, was) AS blob_sha, change, change <> 'removed' AND blob_sha NOT IN (SELECT blob_sha FROM locations WHERE element_id % 3 = 0)
        AND row_number() OVER (PARTITION BY change = 'removed', blob_sha ORDER BY path) = 1 AS job FROM c WHERE change IS NOT NULL""",
        "locations",
    )
)
def settled_subtree(t: Tables) -> DataFrame:
    return _relisted(t)[0]


@query(with_views(f"{_LISTED_SQL} SELECT path, blob_sha FROM then_ WHERE NOT starts_with(path, 'en/') UNION ALL SELECT path, blob_sha FROM now WHERE starts_with(path, 'en/')", "locations"))
def settled_map(t: Tables) -> DataFrame:
    return _relisted(t)[1]


# References between lines of documents, of which some name a file or a line that is not there.
_EDGES_SQL = """n AS (SELECT event_id AS id, user_id AS file, event_id % 40 AS location FROM events WHERE event_id % 6 <> 1),
    x AS (SELECT user_id AS from_file, event_id % 40 AS from_location, user_id + 1 AS to_file, (event_id * 7) % 40 AS to_location FROM events WHERE event_id % 10 = 0),
    p AS (SELECT x.*, a.id AS from_id, b.id AS to_id FROM x LEFT JOIN n a ON a.file = from_file AND a.location = from_location LEFT JOIN n b ON b.file = to_file AND b.location = to_location)"""


def _edges(t: Tables) -> tuple[DataFrame, DataFrame]:
    i, u = F.col("event_id"), F.col("user_id")
    nodes = t.events.where(i % 6 != 1).select(i.alias("id"), u.alias("file"), (i % 40).alias("location"))
    edges = t.events.where(i % 10 == 0).select(u.alias("from_file"), (i % 40).alias("from_location"), (u + 1).alias("to_file"), (i * 7 % 40).alias("to_location"))
    return upkeep.attached(edges, nodes)


@query(f"WITH {_EDGES_SQL} SELECT * FROM p WHERE from_id IS NOT NULL AND to_id IS NOT NULL")
def attached_edges(t: Tables) -> DataFrame:
    return _edges(t)[0]


@query(f"WITH {_EDGES_SQL} SELECT from_file, from_location, to_file, to_location, CASE WHEN from_id IS NULL AND to_id IS NULL THEN 'both' WHEN from_id IS NULL THEN 'from' ELSE 'to' END AS missing FROM p WHERE from_id IS NULL OR to_id IS NULL")
def unattached_edges(t: Tables) -> DataFrame:
    return _edges(t)[1]


@query(
    """WITH c AS (SELECT event_id AS conv_id, CASE WHEN event_id % 4 > 0 THEN 'r' || (event_id % 3) END AS identity, CASE WHEN event_id % 9 > 0 THEN user_id END AS worktree, ts AS made FROM events),
    n AS (SELECT worktree, identity AS new FROM (SELECT *, row_number() OVER (PARTITION BY worktree ORDER BY identity IS NULL, made DESC, conv_id DESC) AS n FROM c WHERE worktree IS NOT NULL) WHERE n = 1 AND identity IS NOT NULL)
    SELECT conv_id, identity AS old, new FROM c JOIN n USING (worktree) WHERE identity IS DISTINCT FROM new"""
)
def settled_identities(t: Tables) -> DataFrame:
    i = F.col("event_id")
    rows = t.events.select(i.alias("conv_id"), F.when(i % 4 > 0, F.concat(F.lit("r"), i % 3)).alias("identity"), F.when(i % 9 > 0, F.col("user_id")).alias("worktree"), F.col("ts").alias("at"))
    return upkeep.settled_identities(rows)

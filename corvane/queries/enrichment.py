"""Parsing, structured documents, summaries, vectors and the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import scratch
from corvane.functions import text
from corvane.model import Tables, with_views
from corvane.operators import gates, lexical, parsing, upkeep
from corvane.queries import query
from corvane.queries.search import _scored_sql

_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    m AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN repeat('#', 1 + CAST((pos // 3) % 3 AS INTEGER)) || ' ' || raw ELSE raw END AS line FROM l),
    h AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6} ') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM m)"""


@query(
    f"""WITH {_LINES} SELECT doc_id, CAST(pos + 1 AS INTEGER) AS start, CAST(coalesce((SELECT min(n.pos) FROM h n WHERE n.doc_id = h.doc_id AND n.pos > h.pos AND n.level <= h.level),
        (SELECT max(x.pos) + 1 FROM h x WHERE x.doc_id = h.doc_id)) AS INTEGER) AS stop, CAST(level AS INTEGER) AS level, trim(regexp_replace(line, '^#+ ', '')) AS title FROM h WHERE level IS NOT NULL"""
)
def markdown_sections(t: Tables) -> DataFrame:
    def headed(line, i):
        return F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 3).cast("int") % 3), F.lit(" "), line)).otherwise(line)

    return parsing.sections(t.documents, "doc_id", F.array_join(F.transform(F.split("text", "\n"), headed), "\n"))


@query("SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(concat_ws(chr(10), 'doc_' || doc_id, text)), '[a-z0-9_]+')) AS token FROM documents) GROUP BY token")
def token_postings(t: Tables) -> DataFrame:
    return parsing.postings(t.elements.where("kind = 'file'")).groupBy("token").agg(F.count("*").alias("df"))


@query(
    with_views(
        _scored_sql("the and with", "TRUE")
        + """SELECT id, score FROM scored WHERE regexp_matches(t, '(^|[^a-z0-9_])the') AND regexp_matches(t, '(^|[^a-z0-9_])and') AND regexp_matches(t, '(^|[^a-z0-9_])with')""",
        "turns",
        "elements",
    )
)
def lexical_indexed(t: Tables) -> DataFrame:
    index = scratch.once(t.spark, f"tokens of {t.folder}", lambda: parsing.stored_index(t.elements))
    ids = parsing.candidates(index, lexical.query_terms("the and with"))
    return lexical.scored(t.elements.join(ids, "id", "left_semi"), "the and with").select("id", "score")


@query()
def embedded_chunks(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"), 2000, 200)).alias("chunk_no", "chunk"))
    return cut.where(F.trim("chunk") != "").select("doc_id", "chunk_no", parsing.embed("chunk").alias("embedding"))


@query(
    """WITH RECURSIVE d AS (SELECT doc_id AS id, source, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    w(id, source, tokens, n, held, batch) AS (SELECT id, source, tokens, n, tokens, 0 FROM d WHERE n = 1
        UNION ALL SELECT d.id, d.source, d.tokens, d.n, CASE WHEN held + d.tokens > 20000 THEN d.tokens ELSE held + d.tokens END, CASE WHEN held + d.tokens > 20000 THEN batch + 1 ELSE batch END FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
    SELECT source, id, tokens, batch FROM w"""
)
def token_batches(t: Tables) -> DataFrame:
    sized = t.documents.select(F.col("doc_id").alias("id"), "source", text.token_estimate(F.col("text")).alias("tokens"))
    return upkeep.batches(sized, "source", "tokens", 20000).select("source", "id", "tokens", "batch")


_ROWS = """r AS (SELECT event_id AS id, user_id AS grp, event_type AS state, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS derived, CASE WHEN event_id % 5 > 0 THEN event_id % 4 = 0 END AS gate FROM events)"""


def _rows(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return t.events.select(
        i.alias("id"), F.col("user_id").alias("grp"), F.col("event_type").alias("state"), F.when(i % 3 == 0, i % 2 == 0).alias("derived"), F.when(i % 5 > 0, i % 4 == 0).alias("gate")
    )


@query(f"WITH {_ROWS} SELECT id, grp FROM r WHERE coalesce(derived, gate) = FALSE")
def open_gates(t: Tables) -> DataFrame:
    return gates.gate_open(_rows(t), True, F.col("derived"), F.col("gate")).select("id", "grp")


@query(
    f"""WITH {_ROWS} SELECT grp, count(*) FILTER (state NOT IN ('purchase', 'click', 'view')) = 0 AS complete,
        coalesce(string_agg(id, ',' ORDER BY id) FILTER (state NOT IN ('purchase', 'click', 'view')), '') AS incomplete FROM r GROUP BY grp"""
)
def derived_completion(t: Tables) -> DataFrame:
    return gates.derived_state(_rows(t), "grp", ("purchase", "click", "view"))


@query(
    """WITH e AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'file' ELSE 'section' END AS kind, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN doc_id - doc_id % 4 END AS parent_id FROM documents)
    SELECT id, kind FROM e WHERE kind <> 'file' OR id NOT IN (SELECT parent_id FROM e WHERE parent_id IS NOT NULL)"""
)
def container_suppression(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    e = t.documents.select(d.alias("id"), F.when(d % 4 == 0, "file").otherwise("section").alias("kind"), F.when((d % 4 != 0) & (d % 3 == 0), d - d % 4).alias("parent_id"))
    return gates.without_container_files(e).select("id", "kind")


@query(
    """WITH e AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'file' ELSE 'section' END AS kind, text, len(string_split(text, chr(10))) AS lines FROM documents)
    SELECT doc_id FROM e WHERE trim(text) <> '' AND kind <> 'file' AND lines >= 10"""
)
def wants_summary(t: Tables) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "file").otherwise("section")
    return t.documents.where(gates.wants_summary(kind, F.col("text"), F.size(F.split("text", "\n")))).select("doc_id")


_SUMMARIES = "s AS (SELECT user_id AS raw_hash, (['a', 'b', 'c', 'd'])[1 + event_id % 4] AS model, event_id AS created FROM events)"


@query(
    f"""WITH {_SUMMARIES}, p AS (SELECT *, row_number() OVER (PARTITION BY raw_hash ORDER BY CASE model WHEN 'c' THEN 1 WHEN 'a' THEN 2 ELSE 3 END, created, model) AS n FROM s)
    SELECT raw_hash, model, created FROM p WHERE n = 1"""
)
def preferred_summaries(t: Tables) -> DataFrame:
    models = F.array(*map(F.lit, "abcd"))
    s = t.events.select(F.col("user_id").alias("raw_hash"), models[(F.col("event_id") % 4).cast("int")].alias("model"), F.col("event_id").alias("created"))
    return gates.preferred_summaries(s, "raw_hash", ["c", "a"])


@query(
    """WITH e AS (SELECT doc_id AS id, sha256(text) AS h, sha256(upper(text)) AS u FROM documents),
    s AS (SELECT h, u FROM e WHERE id % 3 = 0), v AS (SELECT id AS vector_id, CASE WHEN id % 2 = 0 THEN h ELSE u END AS source FROM e WHERE id % 5 < 3)
    SELECT id, coalesce((SELECT min(vector_id) FROM s JOIN v ON v.source = s.u WHERE s.h = e.h), (SELECT min(vector_id) FROM v WHERE v.source = e.h), -1) AS vector_id FROM e"""
)
def work_vectors(t: Tables) -> DataFrame:
    e = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("raw_hash"), F.sha2(F.upper("text"), 256).alias("u"))
    s = e.where("id % 3 = 0").select("raw_hash", F.col("u").alias("text_hash"))
    v = e.where("id % 5 < 3").select(F.col("id").alias("vector_id"), F.when(F.col("id") % 2 == 0, F.col("raw_hash")).otherwise(F.col("u")).alias("source_hash"))
    return gates.work_vectors(e.select("id", "raw_hash"), s, v).fillna(-1, ["vector_id"])


@query(
    """WITH d AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '  ' WHEN 1 THEN ' <local-command-caveat>' || text WHEN 2 THEN '/compact' WHEN 3 THEN '<task-notification>' || text ELSE text END AS body FROM documents)
    SELECT rule, count(*) AS n FROM (SELECT CASE WHEN trim(body) = '' THEN 'empty' WHEN ltrim(body) LIKE '<local-command-caveat>%' THEN 'local_command_caveat'
        WHEN trim(body) = '/compact' OR contains(body, '<command-name>/compact</command-name>') THEN 'compact' WHEN ltrim(body) LIKE '<task-notification>%' THEN 'task_notification' ELSE 'none' END AS rule FROM d) GROUP BY rule"""
)
def stop_rules(t: Tables) -> DataFrame:
    n = F.col("doc_id") % 6
    body = F.when(n == 0, "  ").when(n == 1, F.concat(F.lit(" <local-command-caveat>"), "text")).when(n == 2, "/compact").when(n == 3, F.concat(F.lit("<task-notification>"), "text")).otherwise(F.col("text"))
    return t.documents.select(F.coalesce(gates.stop_rule(body), F.lit("none")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_id % 10 < 5), x AS (SELECT user_id, arg_max(event_type <> 'error', event_id) AS held FROM events WHERE event_id % 10 >= 5 GROUP BY 1)
    SELECT user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM x WHERE NOT held) UNION SELECT user_id FROM x WHERE held"""
)
def scope_cache_delta(t: Tables) -> DataFrame:
    e = t.events
    changes = e.where("event_id % 10 >= 5").select("user_id", (F.col("event_type") != "error").alias("held"), F.col("event_id").alias("version"))
    return gates.cached_scope(e.where("event_id % 10 < 5").select("user_id").distinct(), changes, "user_id")


@query(
    """WITH g AS (SELECT doc_id, sha256(source || ':' || doc_id) AS h FROM documents)
    SELECT doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-8' || substring(h, 14, 3) || '-8' || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS guid, '8' AS version FROM g"""
)
def conversation_guids(t: Tables) -> DataFrame:
    guid = gates.conversation_guid(F.concat_ws(":", "source", "doc_id"))
    return t.documents.select("doc_id", guid.alias("guid"), gates.uuid_version(guid).alias("version"))


@query("SELECT doc_id, 'example.com/' || source || '/' || lang AS key FROM documents")
def repository_keys(t: Tables) -> DataFrame:
    path = F.concat("source", F.lit("/"), "lang")
    forms = [F.concat(F.lit("https://Example.com/"), path, F.lit(".git")), F.concat(F.lit("git@example.com:"), path), F.concat(F.lit("ssh://git@EXAMPLE.com:22/"), path, F.lit("/")), F.concat(F.lit("https://u:p@example.com/"), path)]
    return t.documents.select("doc_id", text.repository_key(F.array(*forms)[(F.col("doc_id") % 4).cast("int")]).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) ELSE lower(p_type) END AS model FROM part")
def canonical_models(t: Tables) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    name = F.when(even, F.concat(F.lit("Provider/"), "p_brand", F.lit("-20250101"))).otherwise(F.concat(F.lit(" "), "p_type", F.lit("[1m]")))
    return t.part.select("p_partkey", text.canonical_model(name).alias("model"))


@query("SELECT p_partkey, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')) || ' box' AS tag FROM part")
def tag_normalise(t: Tables) -> DataFrame:
    tag = F.concat(F.regexp_replace("p_type", "[^A-Za-z0-9]+", "-"), F.lit(" #"), "p_partkey", F.lit(" `Boxes`"))
    return t.part.select("p_partkey", text.canonical_tag(tag).alias("tag"))


@query(
    """WITH h AS (SELECT doc_id, text, strlen(text) AS n, hex(encode(text)) AS h FROM documents),
    c AS (SELECT *, CASE WHEN substr(h, 1025, 1) NOT IN ('8', '9', 'A', 'B') THEN 512 WHEN substr(h, 1023, 1) NOT IN ('8', '9', 'A', 'B') THEN 511 WHEN substr(h, 1021, 1) NOT IN ('8', '9', 'A', 'B') THEN 510 ELSE 509 END AS at FROM h)
    SELECT doc_id, n > 512 AS truncated, n AS total_bytes, sha256(CASE WHEN n <= 512 THEN text ELSE decode(unhex(substr(h, 1, 2 * c.at))) END) AS whole FROM c"""
)
def tool_output_heads(t: Tables) -> DataFrame:
    h = text.head(F.col("text"))
    rows = t.documents.select("doc_id", h.alias("h"))
    return rows.select("doc_id", "h.truncated", F.col("h.total_bytes").cast("long").alias("total_bytes"), F.sha2("h.head", 256).alias("whole"))

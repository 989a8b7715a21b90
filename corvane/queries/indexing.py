"""Index upkeep: missing work, parses, garbage, upserts, differences, chunks and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import scratch
from corvane.functions import text
from corvane.model import Tables, with_views
from corvane.operators import maintenance
from corvane.queries import query


@query("SELECT raw_hash, min(id) AS id FROM (SELECT sha256(text) AS raw_hash, doc_id AS id FROM documents) d WHERE raw_hash NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) GROUP BY raw_hash")
def missing_vectors(t: Tables) -> DataFrame:
    wanted = t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("raw_hash"))
    done = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select(F.sha2("text", 256).alias("raw_hash"))
    return maintenance.missing(wanted, done, "raw_hash")


_PARSES = "parses AS (SELECT doc_id AS id, sha256(text) AS blob_sha, 'v' || (doc_id % 3) AS parser_version FROM documents)"


def _parses(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("blob_sha"), F.concat(F.lit("v"), F.col("doc_id") % 3).alias("parser_version"))


@query(f"WITH {_PARSES} SELECT * FROM parses p WHERE parser_version = 'v2' OR NOT EXISTS (SELECT 1 FROM parses c WHERE c.blob_sha = p.blob_sha AND c.parser_version = 'v2')")
def one_parse_per_blob(t: Tables) -> DataFrame:
    return maintenance.current_parses(_parses(t), "v2")


@query(f"WITH {_PARSES} SELECT * FROM parses p WHERE parser_version <> 'v2' AND EXISTS (SELECT 1 FROM parses c WHERE c.blob_sha = p.blob_sha AND c.parser_version = 'v2')")
def prune_superseded(t: Tables) -> DataFrame:
    return maintenance.superseded_parses(_parses(t), "v2")


@query(f"WITH {_PARSES} SELECT blob_sha, string_agg(parser_version, ',' ORDER BY id DESC) AS versions FROM (SELECT blob_sha, parser_version, max(id) AS id FROM parses GROUP BY ALL) GROUP BY blob_sha")
def parser_versions(t: Tables) -> DataFrame:
    last = _parses(t).groupBy("blob_sha", "parser_version").agg(F.max("id").alias("id"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "parser_version")), asc=False), lambda x: x["parser_version"])
    return last.groupBy("blob_sha").agg(F.array_join(listed, ",").alias("versions"))


@query(
    """WITH e AS (SELECT doc_id, source, lang, doc_id % 6 = 0 AS root FROM documents)
    SELECT source, lang, count(*) FILTER (root) AS roots, coalesce(string_agg(doc_id, ',' ORDER BY doc_id) FILTER (root), '') AS ids FROM e GROUP BY source, lang HAVING count(*) FILTER (root) <> 1"""
)
def tree_inconsistencies(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), "source", "lang")
    return maintenance.tree_inconsistencies(rows, ["source", "lang"], F.col("id") % 6 == 0)


@query(
    """WITH e AS (SELECT doc_id AS id, sha256(text) AS blob_sha, sha256(text) AS raw_hash FROM documents),
    live AS (SELECT sha256(text) AS blob_sha FROM documents WHERE doc_id % 3 <> 0),
    s AS (SELECT sha256(text) AS raw_hash, sha256(upper(text)) AS text_hash FROM documents WHERE doc_id % 2 = 0),
    v AS (SELECT sha256(text) AS source_hash FROM documents WHERE doc_id % 5 < 2 UNION ALL SELECT sha256(upper(text)) FROM documents WHERE doc_id % 4 = 0),
    j AS (SELECT sha256(text) AS raw_hash FROM documents WHERE doc_id % 7 = 0),
    ke AS (SELECT * FROM e WHERE blob_sha IN (SELECT blob_sha FROM live)), ks AS (SELECT * FROM s WHERE raw_hash IN (SELECT raw_hash FROM ke)),
    kv AS (SELECT * FROM v WHERE source_hash IN (SELECT raw_hash FROM ke UNION SELECT text_hash FROM ks)), kj AS (SELECT * FROM j WHERE raw_hash IN (SELECT raw_hash FROM ke)),
    l AS (SELECT 'jobs' AS level, (SELECT count(*) FROM j) AS total, (SELECT count(*) FROM kj) AS kept UNION ALL SELECT 'elements', (SELECT count(*) FROM e), (SELECT count(*) FROM ke)
    UNION ALL SELECT 'summaries', (SELECT count(*) FROM s), (SELECT count(*) FROM ks) UNION ALL SELECT 'vectors', (SELECT count(*) FROM v), (SELECT count(*) FROM kv))
    SELECT *, total - kept AS freed FROM l"""
)
def gc_levels(t: Tables) -> DataFrame:
    docs = scratch.kept(t.documents.select("doc_id", F.sha2("text", 256).alias("h"), F.sha2(F.upper("text"), 256).alias("u")))  # texts are hashed once
    vectors = docs.where("doc_id % 5 < 2").select(F.col("h").alias("source_hash")).union(docs.where("doc_id % 4 = 0").select("u"))
    return maintenance.collect_garbage(
        docs.where("doc_id % 7 = 0").select(F.col("h").alias("raw_hash")),
        docs.select("doc_id", F.col("h").alias("blob_sha"), F.col("h").alias("raw_hash")),
        docs.where("doc_id % 2 = 0").select(F.col("h").alias("raw_hash"), F.col("u").alias("text_hash")),
        vectors,
        docs.where("doc_id % 3 <> 0").select(F.col("h").alias("blob_sha")),
    )


@query(
    """WITH a AS (SELECT lang || '/' || (doc_id % 400) AS path, max(sha256(text)) AS blob_sha FROM documents WHERE doc_id % 10 <> 1 GROUP BY 1),
    b AS (SELECT lang || '/' || (doc_id % 400) AS path, max(sha256(text)) AS blob_sha FROM documents WHERE doc_id % 10 <> 2 GROUP BY 1)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM a FULL JOIN b ON a.path = b.path WHERE a.blob_sha IS DISTINCT FROM b.blob_sha"""
)
def snapshot_diff(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.concat("lang", F.lit("/"), F.col("doc_id") % 400).alias("path"), F.sha2("text", 256).alias("blob_sha"))
    tree = lambda without: docs.where(F.col("doc_id") % 10 != without).groupBy("path").agg(F.max("blob_sha").alias("blob_sha"))
    return maintenance.snapshot_diff(tree(1), tree(2))


@query(
    """WITH u AS (SELECT user_id, event_type, value, event_id AS version FROM events)
    SELECT user_id, event_type, round(value, 6) AS value, version FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY version DESC) AS n FROM u) WHERE n = 1"""
)
def merge_upsert(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", F.round("value", 6).alias("value"), F.col("event_id").alias("version"))
    return maintenance.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["user_id", "event_type"], "version")


@query("SELECT sha256(line) AS raw_hash, count(DISTINCT doc_id) AS conversations, count(*) AS turns FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5")
def shared_hashes(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.sha2("line", 256).alias("raw_hash"))
    return maintenance.shared_hashes(lines, 5, conversation="doc_id")


@query(
    """WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 1800.0) AS BIGINT)))) AS chunk_no FROM documents)
    SELECT doc_id, chunk_no, sha256(substring(text, chunk_no * 1800 + 1, 2000)) AS chunk_hash, length(substring(text, chunk_no * 1800 + 1, 2000)) AS n_chars FROM c"""
)
def chunks(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.posexplode(text.chunks(F.col("text"), 2000, 200)).alias("chunk_no", "chunk"))
    return cut.select("doc_id", F.col("chunk_no").cast("long"), F.sha2("chunk", 256).alias("chunk_hash"), F.length("chunk").cast("long").alias("n_chars"))


@query("SELECT doc_id, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS tokens FROM documents")
def token_estimates(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, array_to_string(string_split(rtrim(text, chr(10)), chr(10))[1:5], chr(10)) AS snippet, left(string_split(text, chr(10))[1], 60) AS first_line FROM documents")
def snippets(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"), text.first_line(F.col("text"), 60).alias("first_line"))


@query(
    """WITH f AS (SELECT doc_id, source || '.' || (['py', 'md', 'json', 'bin', 'RS', 'lock'])[1 + doc_id % 6] AS path, strlen(text) AS size FROM documents),
    e AS (SELECT *, lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)) AS ext FROM f),
    l AS (SELECT *, CASE WHEN ext IN ('py', 'rs') THEN 'source' WHEN ext = 'md' THEN 'document' WHEN ext IN ('json', 'lock') THEN 'config' ELSE 'unknown' END AS family FROM e)
    SELECT doc_id, family, CASE WHEN family = 'unknown' THEN 'unsupported-extension' WHEN family = 'config' THEN 'config-format' WHEN size > 20000 THEN 'too-large' WHEN size < 40 THEN 'too-small' END AS skip_reason FROM l"""
)
def discovery_verdicts(t: Tables) -> DataFrame:
    exts = F.array(*map(F.lit, ("py", "md", "json", "bin", "RS", "lock")))
    files = t.documents.select("doc_id", F.concat("source", F.lit("."), exts[(F.col("doc_id") % 6).cast("int")]).alias("path"), F.octet_length("text").alias("size"))
    family = text.language_family(F.col("path"))
    return files.select("doc_id", family.alias("family"), text.skip_reason(family, F.col("size"), largest=20000, least=40).alias("skip_reason"))


@query(
    """WITH f AS (SELECT CASE doc_id % 6 WHEN 3 THEN 'unsupported-extension' WHEN 2 THEN 'config-format' WHEN 5 THEN 'config-format' ELSE CASE WHEN strlen(text) > 20000 THEN 'too-large' WHEN strlen(text) < 40 THEN 'too-small' END END AS skip_reason FROM documents)
    SELECT skip_reason, count(*) AS n FROM f WHERE skip_reason IS NOT NULL GROUP BY 1"""
)
def skip_counts(t: Tables) -> DataFrame:
    return discovery_verdicts(t).where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


@query(
    "SELECT page_id, len(regexp_extract_all(html, '<[hH][1-6][ >]')) AS headings FROM pages"
)
def page_headings(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<[hH][1-6][ >]")).cast("long").alias("headings"))


@query(
    with_views(
        """SELECT turns.conv_id, turn_no, address, 'conv:' || regexp_extract(address, '^conv:([^#]+)', 1) AS parent, CAST(regexp_extract(address, '#t([0-9]+)$', 1) AS BIGINT) AS parsed_no FROM turns""", "turns"
    )
)
def parsed_addresses(t: Tables) -> DataFrame:
    guid, number = text.conversation_address(F.col("address"))
    return t.turns.select("conv_id", "turn_no", "address", F.concat(F.lit("conv:"), guid).alias("parent"), number.alias("parsed_no"))

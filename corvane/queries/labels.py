"""Scopes of questions, labels of conversations and communities, wanted jobs, locations and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import calls
from corvane.model import Tables, with_views
from corvane.operators import labels, maintenance, scope
from corvane.queries import query


# Every third repository is not registered; a question names one, all of them or none, and comes from its document's folder.
@query(
    with_views(
        """w AS (SELECT DISTINCT identity, root_path FROM locations WHERE element_id % 3 <> 0 AND identity <> 'src1'),
        a AS (SELECT doc_id AS ask_id, CASE doc_id % 4 WHEN 0 THEN ' ' || source WHEN 1 THEN CASE WHEN doc_id % 8 = 1 THEN 'All' ELSE '' END END AS named,
            CASE WHEN doc_id % 5 <> 0 THEN source || '/' || lang || '/d' || (doc_id % 10) END AS cwd, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'src' || (doc_id % 7) END AS checkout FROM documents),
        n AS (SELECT ask_id, CASE WHEN trim(named) <> '' THEN trim(named) END AS named, cwd, checkout FROM a),
        p AS (SELECT n.*, w.root_path, w.identity FROM n LEFT JOIN w ON cwd = w.root_path OR starts_with(cwd, w.root_path || '/')),
        f AS (SELECT *, named IS NOT NULL AND lower(named) <> 'all' AS by_name, named IS NULL AND root_path IS NOT NULL AS inside, named IS NULL AND root_path IS NULL AND cwd IS NOT NULL AS outside,
            checkout IN (SELECT identity FROM w) AS known FROM p)
        SELECT ask_id, CASE WHEN by_name THEN named WHEN inside THEN identity WHEN outside AND known THEN checkout END AS scope_repo, CASE WHEN inside THEN root_path END AS worktree,
            CASE WHEN by_name THEN 'flag' WHEN inside OR (outside AND known) THEN 'cwd' ELSE 'everything' END AS source,
            CASE WHEN by_name AND named NOT IN (SELECT identity FROM w) THEN 'not-indexed' WHEN outside AND known THEN 'unregistered-checkout' WHEN outside THEN 'not-indexed' END AS warning FROM f""",
        "locations",
    )
)
def resolved_scopes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    asks = t.documents.select(
        d.alias("ask_id"),
        F.when(d % 4 == 0, F.concat(F.lit(" "), "source")).when(d % 8 == 1, "All").when(d % 4 == 1, "").alias("repo"),
        F.when(d % 5 != 0, F.concat("source", F.lit("/"), "lang", F.lit("/d"), d % 10)).alias("cwd"),
        F.when(d % 2 == 0, F.col("source")).otherwise(F.concat(F.lit("src"), d % 7)).alias("checkout"),
    )
    return scope.resolve_scopes(asks, t.locations.where("element_id % 3 <> 0 AND identity <> 'src1'").select("identity", "root_path").distinct())


_WORDS = "regexp_extract_all(lower(body), '[a-z]{3,}')"


@query(
    with_views(
        f"""x AS (SELECT conv_id, turn_no, unnest({_WORDS}) AS tag FROM turns WHERE turn_class = 'work'), c AS (SELECT conv_id, tag, count(*) AS n FROM x GROUP BY 1, 2),
        top AS (SELECT * FROM (SELECT conv_id, tag, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, tag) AS rank FROM c) WHERE rank <= 3),
        h AS (SELECT conv_id, turn_no, sum(4 - rank) AS held FROM (SELECT DISTINCT * FROM x) JOIN top USING (conv_id, tag) GROUP BY 1, 2),
        s AS (SELECT t.conv_id, t.turn_no, coalesce(held, 0) + 2.0::DOUBLE * (1.0::DOUBLE / t.turn_no) AS score, length(left(split_part(body, chr(10), 1), 60)) >= 40 AS has_body FROM turns t LEFT JOIN h USING (conv_id, turn_no) WHERE turn_class = 'work')
        SELECT conv_id, turn_no, score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, has_body DESC, turn_no) AS n FROM s) WHERE n = 1""",
        "turns",
    )
)
def representative_turns(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("body"), F.lit("[a-z]{3,}"), F.lit(0))
    work = t.turns.where("turn_class = 'work'").withColumn("words", words)
    counted = work.select("conv_id", F.explode("words").alias("tag")).groupBy("conv_id", "tag").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "tag")))
    summary = F.left(F.split("body", "\n")[0], F.lit(60)).alias("summary")
    return labels.representatives(work.select("conv_id", "turn_no", summary, F.array_distinct("words").alias("tags"), (F.lit(1.0) / F.col("turn_no")).alias("centrality")), ranked)


@query(
    """WITH t AS (SELECT lang AS community, doc_id AS member, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS tag FROM documents),
    c AS (SELECT community, tag, count(*) AS n, count(DISTINCT member) AS carriers FROM t GROUP BY 1, 2),
    s AS (SELECT community, count(*) AS total, count(DISTINCT member) AS members FROM t GROUP BY 1), g AS (SELECT tag, sum(n)::DOUBLE AS corpus FROM c GROUP BY 1),
    l AS (SELECT community, tag, n / total AS share, (n / total) / (corpus / (SELECT sum(total) FROM s)) AS lift, carriers / members AS cover FROM c JOIN s USING (community) JOIN g USING (tag)),
    r AS (SELECT *, round(share * ln(lift) * (0.25 + cover), 9) AS score FROM l WHERE lift > 1)
    SELECT community, tag, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY (lift >= 2.0) DESC, score DESC, tag) AS rank FROM r) WHERE rank <= 6"""
)
def community_tags(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("tags")
    return labels.listed_community_tags(t.documents.select(F.col("lang").alias("community"), F.col("doc_id").alias("member"), words))


# A document is a job: half name their own text, the rest its items; content in English is alive, as are summaries of some sources.
@query(
    """WITH j AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS raw, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS item, sha256(source) AS smart FROM documents),
    r AS (SELECT sha256(text) AS h FROM documents WHERE lang = 'en'), s AS (SELECT sha256(source) AS h FROM documents WHERE source = 'src2')
    SELECT id FROM j WHERE raw IN (SELECT h FROM r) OR (raw IS NULL AND (item IN (SELECT h FROM r) OR smart IN (SELECT h FROM s)))"""
)
def wanted_jobs(t: Tables) -> DataFrame:
    d, own, other = F.col("doc_id"), F.sha2("text", 256), F.sha2("source", 256)
    items = F.when(d % 2 != 0, F.when(d % 3 == 0, F.array(F.array(own, F.lit("x")), F.array(other))).otherwise(F.array(F.array(other))))
    jobs = t.documents.select(d.alias("id"), F.to_json(F.struct(F.when(d % 2 == 0, own).alias("raw_hash"), items.alias("items"))).alias("payload"))
    raw = t.documents.where("lang = 'en'").select(own.alias("hash"))
    smart = t.documents.where("source = 'src2'").select(other.alias("hash"))
    return maintenance.wanted_jobs(jobs, raw, smart).select("id")


@query("SELECT doc_id, lang AS section, source AS part, CAST(doc_id % 100 AS BIGINT) AS index FROM documents WHERE doc_id % 4 <> 3")
def row_locations(t: Tables) -> DataFrame:
    written = F.concat(F.lit("$.sections["), "lang", F.when(F.col("doc_id") % 4 != 3, "].value[").otherwise("].rows["), "source", F.lit("]["), F.col("doc_id") % 100, F.lit("]"))
    rows = t.documents.select("doc_id", calls.row_location(written).alias("at")).where("at IS NOT NULL")
    return rows.select("doc_id", "at.section", F.col("at.parts")[0].alias("part"), "at.index")

"""Lexical, vector and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.model import Tables, with_views
from corvane.operators import hybrid, lexical, provenance, vector
from corvane.operators.lexical import SearchFilters
from corvane.queries import query

PHRASE = "gnu general public license"
QUESTION = "what was the and from"
#: Width of the vectors, and the row whose vector is asked for.
ASKED = 0

# The scored rows of a query in SQL: tiers by where the required terms stand.
_D = "0.04 / (1.0 + ln(1.0 + length(raw_text) / 2000.0))"


def _scored_sql(phrase: str, where: str = "TRUE") -> str:
    terms = lexical.query_terms(phrase)
    must = lexical.required_terms(terms)
    in_all = lambda c, ws: " AND ".join(f"contains({c}, '{w}')" for w in ws)
    return f"""scored AS (SELECT *, round(CASE WHEN kind <> 'turn' AND (n = '{phrase}' OR contains(t, '{phrase}')) THEN 1.0
        WHEN {in_all('n', must)} THEN 0.90 + {_D} WHEN contains(t, '{phrase}') THEN 0.80 + {_D}
        WHEN {in_all('t', terms)} THEN 0.65 + {_D} ELSE 0.60 + {_D} END, 9) AS score, ({in_all('n', must)}) AS name_match,
        coalesce(turn_class IN ('retrieval_call', 'retrieval_result'), FALSE) AS hidden
        FROM (SELECT *, lower(concat_ws(chr(10), name, raw_text)) AS t, lower(name) AS n FROM elements WHERE {where}) WHERE {in_all('t', must)}),
        best AS (SELECT *, row_number() OVER (ORDER BY score DESC, name_match DESC, length(raw_text), id) AS r FROM scored)"""


def _page_sql(limit: int) -> str:
    return f"""SELECT id, kind, name, address, score, name_match, row_number() OVER (ORDER BY r) AS rank FROM best
        WHERE r <= {10 * limit} AND NOT hidden ORDER BY r LIMIT {limit}"""


@query(with_views(_scored_sql(PHRASE) + _page_sql(20), "turns", "elements"))
def lexical_scoped(t: Tables) -> DataFrame:
    return lexical.lexical_search(t.elements, PHRASE, SearchFilters(limit=20))


@query(with_views(_scored_sql(QUESTION) + _page_sql(50), "turns", "elements"))
def lexical_question(t: Tables) -> DataFrame:
    return lexical.lexical_search(t.elements, QUESTION, SearchFilters(limit=50))


@query(with_views(_scored_sql("and the", "kind = 'turn'") + _page_sql(25), "turns", "elements"))
def lexical_conversations(t: Tables) -> DataFrame:
    return lexical.lexical_search(t.elements, "and the", SearchFilters(source="conversation", limit=25))


@query(with_views(_scored_sql("and the", "kind = 'turn' AND address LIKE 'conv:3#t%'") + _page_sql(25), "turns", "elements"))
def lexical_pinned(t: Tables) -> DataFrame:
    return lexical.lexical_search(t.elements, "and the", SearchFilters(source="conversation", address_prefix="conv:3#t", limit=25))


@query(with_views(_scored_sql("and the", "kind = 'turn'") + "SELECT count(*) FILTER (hidden) AS hidden, count(*) FILTER (NOT hidden) AS shown FROM best WHERE r <= 500", "turns", "elements"))
def lexical_hidden_counts(t: Tables) -> DataFrame:
    return lexical.hidden_count(t.elements, "and the", SearchFilters(source="conversation", limit=50))


@query(
    with_views(
        _scored_sql(QUESTION)
        + """, tagged AS (SELECT *, CASE WHEN g = 1 THEN 'wide' ELSE 'scoped' END AS page FROM scored, (VALUES (1), (2)) v(g)
             WHERE g = 1 OR contains(address, 'src3/')),
             ranked AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY score DESC, name_match DESC, length(raw_text), id) AS rank, id, name, score FROM tagged)
             SELECT * FROM ranked WHERE rank <= 10""",
        "turns",
        "elements",
    )
)
def lexical_wide(t: Tables) -> DataFrame:
    return lexical.pages(t.elements, QUESTION, F.col("address").contains("src3/"))


def _asked(t: Tables) -> list[float]:
    return list(t.embeddings.where(F.col("vec_id") == ASKED).select("embedding").first()[0])


_COS = f"""cos AS (SELECT vec_id, label, round(least(1.0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {ASKED}))), 6) AS score FROM embeddings)"""


# Searches for every row whose number is divisible by 100, against all rows.
_EACH = """each AS (SELECT q.vec_id AS asked, r.vec_id AS id, r.label AS label, round(least(1.0, list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score,
    list_sum(list_transform(range(1, len(r.embedding) + 1), lambda i: CASE WHEN (r.embedding[i] > 0) <> (q.embedding[i] > 0) THEN 1 ELSE 0 END)) AS d FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0)"""


def _best_sql(k: int, where: str = "TRUE", source: str = "each") -> str:
    return f"SELECT asked, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


_SHORT = f"short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY d, id) AS place, count(*) OVER (PARTITION BY asked) AS every FROM each) WHERE place <= ceil(every * {vector.SHORTLIST}))"


def _queries(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 100 = 0")


@query(f"WITH {_EACH} {_best_sql(40)}")
def vector_topk(t: Tables) -> DataFrame:
    return vector.search(t.embeddings, _queries(t), 40)


@query(f"WITH {_EACH} {_best_sql(20, 'label IN (1, 3)')}")
def vector_filtered_label(t: Tables) -> DataFrame:
    return vector.search(t.embeddings.where(F.col("label").isin(1, 3)), _queries(t), 20)


@query(
    with_views(
        f"""{_EACH}, ids AS (SELECT min(vec_id) AS vec_id FROM embeddings JOIN locations ON element_id = vec_id WHERE identity = 'src2' OR starts_with(path, 'fr/') GROUP BY blob_sha)
        {_best_sql(20, 'id IN (SELECT vec_id FROM ids)')}""",
        "locations",
    )
)
def vector_scoped(t: Tables) -> DataFrame:
    scope = t.locations.where((F.col("identity") == "src2") | provenance.path_prefix(F.col("path"), "fr"))
    return vector.search(vector.admitted(t.embeddings, scope), _queries(t), 20)


@query(f"WITH {_EACH} {_best_sql(100, 'score >= 0.3')}")
def vector_floor(t: Tables) -> DataFrame:
    return vector.search(t.embeddings, _queries(t), 100, min_score=0.3)


@query(f"WITH {_EACH}, {_SHORT} {_best_sql(20, source='short')}")
def hamming_shortlist(t: Tables) -> DataFrame:
    return vector.search(t.embeddings, _queries(t), 20, share=vector.SHORTLIST)


@query(
    f"""WITH {_EACH}, {_SHORT}, x AS ({_best_sql(20)}), f AS ({_best_sql(20, source='short')})
    SELECT x.asked, count(f.id) AS found, count(*) AS wanted, round(count(f.id) / count(*), 6) AS recall FROM x LEFT JOIN f ON x.asked = f.asked AND x.id = f.id GROUP BY x.asked"""
)
def hamming_shortlist_recall(t: Tables) -> DataFrame:
    return vector.recall(vector.search(t.embeddings, _queries(t), 20), vector.search(t.embeddings, _queries(t), 20, share=vector.SHORTLIST))


# Documents and vectors share their numbers, so a document's vector is the row of its number.
_FUSED = f"""lex AS (SELECT id, score AS ls, rank AS lr FROM ({_page_sql(40)}) WHERE kind = 'file'),
    sem AS (SELECT vec_id AS id, score AS rs, row_number() OVER (ORDER BY score DESC, vec_id) AS rr FROM cos ORDER BY rr LIMIT 40),
    fused0 AS (SELECT coalesce(lex.id, sem.id) AS id, CASE WHEN rr IS NULL THEN 'lexical' WHEN lr IS NULL THEN 'semantic' ELSE 'both' END AS channel,
        round(CASE WHEN rr IS NOT NULL AND lr IS NOT NULL THEN least(1.0, greatest(ls, rs) + 0.1 * greatest(least(ls, rs), 0.0)) ELSE coalesce(ls, rs) END, 6) AS score, lr, rr
        FROM lex FULL JOIN sem ON lex.id = sem.id),
    fused AS (SELECT id, channel, score, row_number() OVER (ORDER BY score DESC, lr NULLS LAST, rr NULLS LAST) AS rank FROM fused0)"""
_HYBRID = _scored_sql("the and", "kind = 'file'") + f", {_COS}, {_FUSED}"


def _fused(t: Tables) -> DataFrame:
    lex = lexical.lexical_search(t.elements, "the and", SearchFilters(source="code", limit=40)).where(F.col("kind") == "file")
    sem = vector.nearest(t.embeddings, _asked(t), 40).withColumnRenamed("vec_id", "id")
    return hybrid.fuse(lex.select("id", "score", "rank"), sem)


@query(with_views(_HYBRID + " SELECT * FROM fused", "turns", "elements"))
def hybrid_fused(t: Tables) -> DataFrame:
    return _fused(t)


_SRC = ", sourced AS (SELECT fused.*, source FROM fused LEFT JOIN documents ON doc_id = id)"


def _sourced(t: Tables) -> DataFrame:
    return _fused(t).join(t.documents.select(F.col("doc_id").alias("id"), "source"), "id", "left")


@query(
    with_views(
        _HYBRID
        + _SRC
        + """, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank) AS k, (SELECT count(DISTINCT source) FROM sourced) AS s FROM sourced),
        m AS (SELECT *, (k > 2 AND score < 1.0 AND s > 1 AND source IS NOT NULL) AS moved FROM n)
        SELECT id, channel, score, source, moved, row_number() OVER (ORDER BY moved, rank) AS rank FROM m""",
        "turns",
        "elements",
    )
)
def hybrid_balanced(t: Tables) -> DataFrame:
    return hybrid.balance(_sourced(t), "source", 2)


@query(with_views(_HYBRID + " SELECT *, (SELECT max(rank) FROM fused) > 20 AS truncated, CASE WHEN (SELECT max(rank) FROM fused) > 20 THEN 20 END AS next_offset FROM fused WHERE rank BETWEEN 11 AND 20", "turns", "elements"))
def hybrid_page2(t: Tables) -> DataFrame:
    return hybrid.page(_fused(t), 10, 10)


@query(with_views(_HYBRID + _SRC + " SELECT source, count(*) AS hits, max(score) AS best FROM sourced WHERE rank <= 30 AND source <> 'src1' GROUP BY source", "turns", "elements"))
def elsewhere_hint(t: Tables) -> DataFrame:
    return hybrid.elsewhere(_sourced(t), "src1", 30, repo="source")


@query(with_views(_scored_sql("and the") + "SELECT CASE WHEN kind = 'turn' THEN 'conversation' WHEN kind IN ('section', 'row') THEN 'doc' ELSE 'code' END AS corpus, count(*) AS n FROM scored GROUP BY 1", "turns", "elements"))
def composition(t: Tables) -> DataFrame:
    return hybrid.composition(lexical.scored(t.elements, "and the"))


@query(
    with_views(
        _scored_sql("and the", "kind = 'turn'")
        + """SELECT id, CASE WHEN source = 'human' AND strlen(body) < 4 * 7 AND contains(lower(body), 'and the') THEN least(score, 0.45) ELSE score END AS score
        FROM scored JOIN turns ON turns.address = scored.address""",
        "turns",
        "elements",
    )
)
def restated_damping(t: Tables) -> DataFrame:
    rows = lexical.scored(t.elements, "and the", SearchFilters(source="conversation")).join(t.turns.select("address", "source"), "address")
    return rows.select("id", hybrid.damped(F.col("score"), F.col("kind"), F.col("source"), F.col("raw_text"), "and the").alias("score"))


@query(
    f"""WITH c AS (SELECT label, i AS pos, avg(CAST(embedding[i + 1] AS DOUBLE)) AS mean, count(*) AS n FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) r(i) GROUP BY label, i)
    SELECT label, CAST(pos AS INTEGER) AS pos, round(mean, 6) AS mean, n FROM c WHERE n >= 5"""
)
def centroids(t: Tables) -> DataFrame:
    return vector.centroids(t.embeddings, "label", 5).withColumn("mean", F.round("mean", 6))


# Edges to the ten nearest vectors, all less their mean.
KNN_SQL = """means AS (SELECT list(mean ORDER BY pos) AS m FROM (SELECT i AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM embeddings, range(1, (SELECT max(len(embedding)) + 1 FROM embeddings)) r(i) GROUP BY i)),
    less AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) - m[i]) AS v FROM embeddings, means),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM less a JOIN less b ON a.vec_id <> b.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM p),
    knn AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, score FROM k WHERE r <= 10)"""


def knn(t: Tables) -> DataFrame:
    return vector.neighbours(vector.centred(t.embeddings), 10)


@query(f"WITH {KNN_SQL} SELECT * FROM knn")
def knn_edges(t: Tables) -> DataFrame:
    return knn(t)

"""Searches through stored indexes: BM25 windows and sign words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import scratch
from corvane.model import Tables, with_views
from corvane.operators import bm25, lexical, signs, vector
from corvane.operators.lexical import SearchFilters
from corvane.queries import query
from corvane.queries.search import _best_sql, _page_sql, _scored_sql

BM25_QUERY, BM25_LIMIT = "where is the public license and of", 20


def _bm25(t: Tables) -> bm25.Index:
    def build() -> str:
        folder = scratch.folder(t.spark)
        bm25.build(t.elements, folder)
        return folder

    return bm25.open_index(t.spark, scratch.once(t.spark, f"bm25 of {t.folder}", build))


_POSTINGS_SQL = """said AS (SELECT id, 'body' AS field, regexp_extract_all(lower(coalesce(raw_text, '')), '[a-z0-9_]+') AS tokens FROM elements
        UNION ALL SELECT id, 'name', regexp_extract_all(lower(coalesce(name, '')), '[a-z0-9_]+') FROM elements),
    sizes AS (SELECT field, count(*) AS n, sum(len(tokens)) AS total FROM said GROUP BY field),
    tf AS (SELECT field, id, length, token, count(*) AS tf FROM (SELECT field, id, len(tokens) AS length, unnest(tokens) AS token FROM said) GROUP BY ALL),
    df AS (SELECT field, token, count(*) AS df FROM tf GROUP BY ALL),
    postings AS (SELECT field, token, id, round(1000000 * (ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (total::DOUBLE / n)))))::BIGINT AS weight
        FROM tf JOIN df USING (field, token) JOIN sizes USING (field))"""


def _window_sql(name: str, words: list[str], k: int, field: str = "body", phrase: bool = False) -> str:
    match = (lambda w: f"token = '{w}'") if phrase else (lambda w: f"starts_with(token, '{w}')")
    best = ", ".join(f"max(weight) FILTER ({match(w)}) AS w{i}" for i, w in enumerate(words))
    held = " AND ".join(f"w{i} IS NOT NULL" for i in range(len(words)))
    follows = f" AND id IN (SELECT id FROM said WHERE field = '{field}' AND contains(' ' || array_to_string(tokens, ' ') || ' ', ' {' '.join(words)} '))" if phrase else ""
    return f"""{name} AS (SELECT id, {' + '.join(f'w{i}' for i in range(len(words)))} AS score FROM (SELECT id, {best} FROM postings WHERE field = '{field}' GROUP BY id)
        WHERE {held}{follows} ORDER BY score DESC, id LIMIT {k})"""


def _windows_sql(phrase: str, k: int) -> str:
    terms = lexical.query_terms(phrase)
    parts = [_window_sql("body_all", terms, k), _window_sql("name_all", terms, k, "name"), _window_sql("body_must", lexical.required_terms(terms), k), _window_sql("in_order", phrase.split(), k, phrase=True)]
    ids = " UNION ".join(f"SELECT id FROM {n}" for n in ("body_all", "name_all", "body_must", "in_order"))
    return f"{_POSTINGS_SQL}, {', '.join(parts)}, hits AS ({ids})"


@query(with_views(f"{_POSTINGS_SQL} SELECT field, token, count(*) AS df, max(weight) AS top FROM postings GROUP BY ALL", "turns", "elements"))
def bm25_terms(t: Tables) -> DataFrame:
    return _bm25(t).terms.select("field", "token", "df", "top")


@query(with_views(f"{_POSTINGS_SQL}, {_window_sql('best', ['the', 'and', 'of'], 50)} SELECT id, score FROM best", "turns", "elements"))
def bm25_top(t: Tables) -> DataFrame:
    return bm25.window(_bm25(t), ["the", "and", "of"], 50)


@query(with_views(f"{_POSTINGS_SQL}, {_window_sql('best', ['general', 'public', 'license'], 30, phrase=True)} SELECT id, score FROM best", "turns", "elements"))
def bm25_phrase(t: Tables) -> DataFrame:
    return bm25.window(_bm25(t), ["general", "public", "license"], 30, phrase=True)


@query(with_views(_windows_sql(BM25_QUERY, 10 * BM25_LIMIT) + ", " + _scored_sql(BM25_QUERY, "id IN (SELECT id FROM hits)") + _page_sql(BM25_LIMIT), "turns", "elements"))
def bm25_search(t: Tables) -> DataFrame:
    return bm25.search(t.elements, _bm25(t), BM25_QUERY, SearchFilters(limit=BM25_LIMIT))


WIDTH = 64


def _signs(t: Tables) -> DataFrame:
    def build() -> str:
        folder = scratch.folder(t.spark)
        signs.build(t.embeddings, folder, "first", WIDTH, "v1")
        return folder

    return signs.opened(t.spark, scratch.once(t.spark, f"signs of {t.folder}", build))


def _worn(t: Tables) -> DataFrame:
    """A copy with gaps, copies of other vectors, of another version and of vectors that are gone."""
    d = F.col("vec_id")
    made = signs.copies(t.embeddings.where(d % 9 != 0), WIDTH, "v1")
    turned = made.withColumn("source_hash", F.when(F.col("id") % 13 == 1, F.lit(0)).otherwise(F.col("source_hash")))
    older = turned.withColumn("version", F.when(F.col("id") % 17 == 2, "v0").otherwise(F.col("version")))
    return older.unionAll(made.withColumn("id", F.col("id") + 1_000_000_000))


_LOST = "vec_id % 9 = 0 OR vec_id % 17 = 2"


@query(f"SELECT label, count(*) AS vectors, count(*) FILTER ({_LOST}) AS missing, count(*) FILTER (NOT ({_LOST}) AND vec_id % 13 = 1) AS drifted FROM embeddings GROUP BY label")
def sign_coverage(t: Tables) -> DataFrame:
    return signs.coverage(t.embeddings, _worn(t), "v1", "label")


@query(f"SELECT vec_id AS id, list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT AS low, embedding[64] > 0 AS last, ({_LOST} OR vec_id % 13 = 1) AS fresh FROM embeddings")
def sign_refresh(t: Tables) -> DataFrame:
    whole, fresh = signs.refreshed(t.embeddings, _worn(t), WIDTH, "v1")
    word = F.col("words")[0]
    marked = whole.join(fresh.select("id", F.lit(True).alias("fresh")), "id", "left")
    return marked.select("id", word.bitwiseAND(F.lit((1 << 63) - 1)).alias("low"), (word < 0).alias("last"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


_AGREE = f"""agree AS (SELECT q.vec_id AS asked, r.vec_id AS id, round(least(1.0, list_cosine_similarity(CAST(r.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 6) AS score,
    round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN r.embedding[i] > 0 THEN q.embedding[i]::DOUBLE ELSE -q.embedding[i]::DOUBLE END)), 6) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0),
    short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY s DESC, id) AS place, count(*) OVER (PARTITION BY asked) AS every FROM agree) WHERE place <= {signs.WANTED * 20} + ceil({signs.SHARE} * every))"""


@query(f"WITH {_AGREE} {_best_sql(20, source='short')}")
def sign_search(t: Tables) -> DataFrame:
    return signs.search(_signs(t), t.embeddings, t.embeddings.where("vec_id % 100 = 0"), 20)


@query(
    f"""WITH {_AGREE}, x AS ({_best_sql(20, source='agree')}), f AS ({_best_sql(20, source='short')})
    SELECT x.asked, count(f.id) AS found, count(*) AS wanted, round(count(f.id) / count(*), 6) AS recall FROM x LEFT JOIN f ON x.asked = f.asked AND x.id = f.id GROUP BY x.asked"""
)
def sign_recall(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 100 = 0")
    return vector.recall(vector.search(t.embeddings, asked, 20), signs.search(_signs(t), t.embeddings, asked, 20))

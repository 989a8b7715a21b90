"""Structured documents and trees over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.model import Tables
from corvane.operators import structured, trees
from corvane.queries import query

# A document as JSON: a section for its title and one for its lines, of which some stand deeper and some are no rows.
_DOCS_SQL = """
    row_texts AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: repeat('{"g": [', (i % 4)::INT) || '{"id": ' || CASE WHEN i % 5 = 4 THEN i::VARCHAR ELSE '"l' || i || '"' END
        || ', "state": "s' || i % 3 || '", "body": ' || to_json(x) || ', "n": ' || i || ', "parts": [{"id": "in' || i || '", "note": ' || to_json(x) || '}]}' || repeat(']}', (i % 4)::INT)) AS lines FROM documents),
    docs AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN ('{"dd": {"schema": "' || lang || '", "sweep_exclude": ' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END
        || '}, "sections": [{"name": "meta", "value": {"title": "Document ' || doc_id || '"}}, {"name": "lines", "value": {"all": [' || array_to_string(lines, ', ') || ']}}]}')::JSON END AS j FROM documents JOIN row_texts USING (doc_id)),
    secs AS (SELECT doc_id, s.key::INT AS pos, s.value->>'name' AS section, s.value->'value' AS node FROM docs, json_each(j, '$.sections') s),
    walk(doc_id, pos, section, trail, place, node) AS (
        SELECT doc_id, pos, section, [section], [pos], node FROM secs
        UNION ALL
        SELECT doc_id, w.pos, section, CASE WHEN json_type(w.node) = 'OBJECT' THEN list_append(trail, e.key) ELSE trail END, list_append(place, e.n), e.value
        FROM walk w, LATERAL (SELECT key, value, (row_number() OVER (ORDER BY lpad(key, 9, '0')))::INT AS n FROM json_each(w.node)) e
        WHERE json_type(w.node) IN ('OBJECT', 'ARRAY') AND coalesce(json_type(w.node, '$.id'), '') <> 'VARCHAR'),
    found AS (SELECT *, list_append(trail, node->>'id') AS full_trail FROM walk WHERE json_type(node, '$.id') = 'VARCHAR')
"""


def _json(text):
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _texts(t: Tables) -> DataFrame:
    def line(x, i):
        n = i + 1
        own = F.when(n % 5 == 4, n.cast("string")).otherwise(F.concat(F.lit('"l'), n, F.lit('"')))
        row = F.concat(F.lit('{"id": '), own, F.lit(', "state": "s'), n % 3, F.lit('", "body": '), _json(x), F.lit(', "n": '), n, F.lit(', "parts": [{"id": "in'), n, F.lit('", "note": '), _json(x), F.lit("}]}"))
        return F.concat(F.repeat(F.lit('{"g": ['), (n % 4).cast("int")), row, F.repeat(F.lit("]}"), (n % 4).cast("int")))

    d = F.col("doc_id")
    lines = F.array_join(F.transform(F.split("text", "\n"), line), ", ")
    head = F.concat(F.lit('{"dd": {"schema": "'), "lang", F.lit('", "sweep_exclude": '), (d % 3 == 0).cast("string"), F.lit('}, "sections": [{"name": "meta", "value": {"title": "Document '), d, F.lit('"}}'))
    whole = F.concat(head, F.lit(', {"name": "lines", "value": {"all": ['), lines, F.lit("]}}]}"))
    return structured.parsed(t.documents.select("doc_id", F.when(d % 11 == 0, F.concat(F.lit("{"), whole)).otherwise(whole).alias("text")))


@query(
    f"""WITH RECURSIVE {_DOCS_SQL}
    SELECT doc_id, lang AS schema, doc_id % 3 = 0 AS sweep_excluded, 'Document ' || doc_id AS title, section, array_to_string(full_trail, ' / ') AS trail,
        row_number() OVER (PARTITION BY doc_id, pos ORDER BY place) - 1 AS sibling_order, node->>'state' AS state,
        array_to_string(full_trail[:-2], ' / ') || CASE WHEN json_type(node, '$.body') = 'VARCHAR' THEN chr(10) || 'body: ' || (node->>'body') ELSE '' END
            || CASE WHEN json_type(node, '$.note') = 'VARCHAR' THEN chr(10) || 'note: ' || (node->>'note') ELSE '' END AS text, 'fallback' AS basis
    FROM found JOIN documents USING (doc_id)"""
)
def document_rows(t: Tables) -> DataFrame:
    return structured.rows(_texts(t)).withColumn("trail", F.array_join("trail", " / "))


@query(
    f"""WITH RECURSIVE {_DOCS_SQL}
    SELECT doc_id, array_to_string(full_trail[:-2], ' / ') || CASE WHEN json_type(node, '$.note') = 'VARCHAR' THEN chr(10) || 'note: ' || (node->>'note') ELSE '' END
        || CASE WHEN json_type(node, '$.body') = 'VARCHAR' THEN chr(10) || 'context body: ' || (node->>'body') ELSE '' END
        || CASE WHEN json_type(node, '$.state') = 'VARCHAR' THEN chr(10) || 'context state: ' || (node->>'state') ELSE '' END AS text, 'schema' AS basis
    FROM found"""
)
def declared_row_texts(t: Tables) -> DataFrame:
    declared = {"lines": structured.Fields(prose=("note",), context=("body", "state", "n"))}
    return structured.rows(_texts(t), declared).select("doc_id", "text", "basis")


@query(
    f"""WITH RECURSIVE {_DOCS_SQL}
    SELECT doc_id, section, section || chr(10) || node::VARCHAR AS text FROM secs WHERE (doc_id, section) NOT IN (SELECT (doc_id, section) FROM found)
    UNION ALL SELECT doc_id, NULL, 'unparseable' FROM docs WHERE j IS NULL""".replace("node::VARCHAR", """'{"title":"Document ' || doc_id || '"}'""")
)
def section_leftovers(t: Tables) -> DataFrame:
    docs = _texts(t)
    plain = structured.section_texts(docs, structured.holders(docs))
    return plain.unionByName(structured.unparseable(docs).select("doc_id", F.lit(None).cast("string").alias("section"), F.lit("unparseable").alias("text")))


# Documents as nodes: every fifty follow each other down forty levels, and the last ten hang on nodes further up.
_NODES_SQL = """nodes AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 50 <= 40 THEN doc_id - 1 ELSE doc_id - doc_id % 10 * 4 - 1 END AS parent, (doc_id % 7)::INT AS sibling_order FROM documents)"""


def _nodes(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    parent = F.when(d % 50 == 0, None).when(d % 50 <= 40, d - 1).otherwise(d - d % 10 * 4 - 1)
    return t.documents.select(d.alias("id"), parent.alias("parent"), (d % 7).cast("int").alias("sibling_order"))


@query(
    f"""WITH RECURSIVE {_NODES_SQL}, tree(id, root, depth, place) AS (SELECT id, id, 0, CAST([] AS STRUCT(s INT, i BIGINT)[]) FROM nodes WHERE parent IS NULL
        UNION ALL SELECT n.id, t.root, t.depth + 1, list_append(t.place, {{'s': n.sibling_order, 'i': n.id}}) FROM tree t JOIN nodes n ON n.parent = t.id)
    SELECT id, root, depth, row_number() OVER (PARTITION BY root ORDER BY place) - 1 AS walk_no FROM tree"""
)
def element_trees(t: Tables) -> DataFrame:
    walk = F.row_number().over(Window.partitionBy("root").orderBy("place")) - 1
    return trees.assembled(_nodes(t)).select("id", "root", "depth", walk.alias("walk_no"))


@query("SELECT source AS blob, count(*) FILTER (WHERE doc_id % 50 = 0) AS roots FROM documents GROUP BY source HAVING count(*) FILTER (WHERE doc_id % 50 = 0) <> 1")
def blobs_without_one_root(t: Tables) -> DataFrame:
    return trees.inconsistent(_nodes(t).join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("blob")), "id"))

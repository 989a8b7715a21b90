"""Conversations: lists, windows, outlines, classes and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.model import Tables, with_views
from corvane.operators import conversations
from corvane.queries import query


@query(with_views("SELECT turn_no, role, source, sha256(body) AS blob_sha FROM turns WHERE conv_id = 1 AND turn_no BETWEEN 2 AND 6", "turns"))
def conversation_window(t: Tables) -> DataFrame:
    return conversations.window(t.turns, 1, 3, 1, 3).select("turn_no", "role", "source", F.sha2("body", 256).alias("blob_sha"))


@query(with_views("SELECT conv_id, turn_no, role, left(split_part(body, chr(10), 1), 80) AS line FROM turns", "turns"))
def outline(t: Tables) -> DataFrame:
    return t.turns.select("conv_id", "turn_no", "role", F.left(F.split("body", "\n")[0], F.lit(80)).alias("line"))


@query(with_views("SELECT conv_id, count(*) AS n_turns, max(turn_no) AS last_turn, count(*) FILTER (role = 'human') AS n_human FROM turns GROUP BY conv_id", "turns"))
def conversation_list(t: Tables) -> DataFrame:
    return t.turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn_no").alias("last_turn"), F.count_if(F.col("role") == "human").alias("n_human"))


@query(with_views("SELECT conv_id, count(*) AS n FROM turns WHERE CAST(conv_id AS VARCHAR) LIKE '1%' GROUP BY conv_id", "turns"))
def conversation_by_prefix(t: Tables) -> DataFrame:
    return t.turns.where(F.col("conv_id").cast("string").startswith("1")).groupBy("conv_id").agg(F.count("*").alias("n"))


@query(
    with_views(
        """f AS (SELECT conv_id, turn_no, length(body) % 3 = 0 AS calls, length(body) % 2 = 0 AS retrieval, length(body) % 3 = 2 AS breaks FROM turns),
        s AS (SELECT *, CASE WHEN calls THEN retrieval WHEN breaks THEN FALSE END AS state FROM f),
        b AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS pending FROM s)
        SELECT conv_id, turn_no, CASE WHEN calls AND retrieval THEN 'retrieval_call' WHEN calls THEN 'tool_call' WHEN NOT breaks AND pending THEN 'retrieval_result' WHEN NOT breaks THEN 'tool_result' ELSE 'work' END AS turn_class FROM b""",
        "turns",
    )
)
def turn_classes(t: Tables) -> DataFrame:
    n = F.length("body")
    return conversations.classify(t.turns, n % 3 == 0, n % 2 == 0, n % 3 == 2).select("conv_id", "turn_no", "turn_class")


@query(
    with_views(
        """r AS (SELECT conv_id, turn_no AS ordinal FROM turns), seen AS (SELECT * FROM r WHERE ordinal <= 2 OR ordinal % 4 = 0),
        n AS (SELECT * FROM r WHERE (conv_id, ordinal) NOT IN (SELECT (conv_id, ordinal) FROM seen))
        SELECT n.conv_id, ordinal, coalesce((SELECT count(*) FROM seen s WHERE s.conv_id = n.conv_id), 0) + row_number() OVER (PARTITION BY n.conv_id ORDER BY ordinal) AS turn_no FROM n""",
        "turns",
    )
)
def appended_turns(t: Tables) -> DataFrame:
    records = t.turns.select("conv_id", F.col("turn_no").alias("ordinal"))
    seen = records.where("ordinal <= 2 OR ordinal % 4 = 0")
    numbered = seen.groupBy("conv_id").agg(F.count("*").alias("turn_no"))
    return conversations.append(seen, records.unionByName(records.where("ordinal % 3 = 0")), ["conv_id"], numbered)


@query(with_views("SELECT conv_id, turn_no, sha256(regexp_replace(body, '\\s+$', '') || chr(10) || chr(10) || '[tool-call ' || source || ']' || chr(10) || name) AS canonical_sha FROM turns", "turns"))
def canonical_turns(t: Tables) -> DataFrame:
    items = F.array(F.struct(F.col("source").alias("tool"), F.col("name").alias("text")))
    return t.turns.select("conv_id", "turn_no", F.sha2(conversations.canonical_text(F.col("body"), items), 256).alias("canonical_sha"))


@query(
    with_views(
        """h AS (SELECT conv_id, max(turn_no) AS l, count(*) AS n FROM turns WHERE conv_id % 7 <> 0 GROUP BY conv_id),
        c AS (SELECT conv_id, max(turn_no) AS l, count(*) AS n FROM turns WHERE conv_id % 5 <> 0 AND (conv_id % 3 <> 0 OR turn_no < 3) GROUP BY conv_id)
        SELECT coalesce(h.conv_id, c.conv_id) AS conv_id, CASE WHEN c.conv_id IS NULL THEN 'new' WHEN h.conv_id IS NULL THEN 'removed' ELSE 'grown' END AS change
        FROM h FULL JOIN c ON h.conv_id = c.conv_id WHERE h.conv_id IS NULL OR c.conv_id IS NULL OR h.l <> c.l OR h.n <> c.n""",
        "turns",
    )
)
def dirty_conversations(t: Tables) -> DataFrame:
    now = conversations.heads(t.turns.where("conv_id % 7 <> 0"))
    cached = conversations.heads(t.turns.where("conv_id % 5 <> 0 AND (conv_id % 3 <> 0 OR turn_no < 3)"))
    return conversations.dirty(now, cached)

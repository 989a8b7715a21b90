"""The engine's tables, derived from the corpus tables.

Content is keyed by the hash of its text; provenance (repository, worktree, path) is a layer of
its own. Each view here has its twin as SQL text in ``VIEWS_SQL`` for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Reads the tables of a folder and gives the derived views, all lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def elements(self) -> DataFrame:
        """One file element for each document and one turn element for each turn of a conversation."""
        files = self.documents.select(
            F.col("doc_id").alias("id"),
            F.lit("file").alias("kind"),
            F.concat(F.lit("doc_"), "doc_id").alias("name"),
            F.concat(F.lit("el:"), "source", F.lit("/"), "lang", F.lit("/"), "doc_id").alias("address"),
            F.col("text").alias("raw_text"),
            F.sha2("text", 256).alias("raw_hash"),
            F.lit(None).cast("string").alias("turn_class"),
        )
        turns = self.turns.select(
            (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn_no")).alias("id"),
            F.lit("turn").alias("kind"),
            "name",
            "address",
            F.col("body").alias("raw_text"),
            F.sha2("body", 256).alias("raw_hash"),
            "turn_class",
        )
        return files.unionByName(turns)

    @property
    def locations(self) -> DataFrame:
        """Where the content of files lives: repository, worktree, path and the blob there."""
        return self.documents.select(
            F.col("source").alias("identity"),
            F.concat("source", F.lit("/"), "lang").alias("root_path"),
            F.concat("lang", F.lit("/d"), F.col("doc_id") % 10, F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
            F.sha2("text", 256).alias("blob_sha"),
            F.col("doc_id").alias("element_id"),
        )

    @property
    def turns(self) -> DataFrame:
        """Turns numbered from 1, with role, source, class and canonical name."""
        human = F.col("role") == "user"
        return self.conversations.select(
            "conv_id",
            (F.col("turn") + 1).alias("turn_no"),
            F.when(human, "human").otherwise("agent").alias("role"),
            F.when(human, "human").when(F.col("role") == "system", "system").otherwise("peer").alias("source"),
            F.col("text").alias("body"),
            F.concat(F.lit("t"), F.col("turn") + 1).alias("name"),
            F.concat(F.lit("conv:"), "conv_id", F.lit("#t"), F.col("turn") + 1).alias("address"),
            F.when(F.col("role") == "system", "retrieval_result").when(human, "prose").otherwise("work").alias("turn_class"),
        )

    @property
    def jobs(self) -> DataFrame:
        """Events read as work: the user is the key, the type decides kind and state."""
        kind = F.when(F.col("event_type").isin("view", "click"), "scan").when(F.col("event_type") == "purchase", "embed").otherwise("summarize")
        state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "running").otherwise("pending")
        return self.events.select(
            F.col("event_id").alias("id"),
            kind.alias("kind"),
            F.concat(kind, F.lit(":"), "user_id").alias("dedupe_key"),
            state.alias("state"),
            (F.col("user_id") % 5).cast("int").alias("priority"),
            F.unix_timestamp("ts").alias("not_before"),
            (F.col("event_id") % 7).cast("int").alias("attempts"),
            (F.col("event_id") % 4).cast("int").alias("parks"),
            F.when(state == "failed", F.concat(F.lit("error "), "event_id")).alias("last_error"),
            F.unix_timestamp("ts").alias("updated_at"),
            F.col("props").alias("payload"),
        )


#: The same views for an engine that speaks SQL; a query's text follows ``WITH``.
VIEWS_SQL = {
    "turns": """turns AS (SELECT conv_id, turn + 1 AS turn_no, CASE WHEN role = 'user' THEN 'human' ELSE 'agent' END AS role,
        CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'system' ELSE 'peer' END AS source, text AS body, 't' || (turn + 1) AS name,
        'conv:' || conv_id || '#t' || (turn + 1) AS address, CASE role WHEN 'system' THEN 'retrieval_result' WHEN 'user' THEN 'prose' ELSE 'work' END AS turn_class
        FROM conversations)""",
    "elements": """elements AS (SELECT doc_id AS id, 'file' AS kind, 'doc_' || doc_id AS name, 'el:' || source || '/' || lang || '/' || doc_id AS address,
        text AS raw_text, sha256(text) AS raw_hash, NULL AS turn_class FROM documents
        UNION ALL SELECT 1000000000 + conv_id * 1000 + turn_no, 'turn', name, address, body, sha256(body), turn_class FROM turns)""",
    "locations": """locations AS (SELECT source AS identity, source || '/' || lang AS root_path, lang || '/d' || (doc_id % 10) || '/' || doc_id || '.txt' AS path,
        sha256(text) AS blob_sha, doc_id AS element_id FROM documents)""",
    "jobs": """jobs AS (SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'scan' WHEN event_type = 'purchase' THEN 'embed' ELSE 'summarize' END AS kind,
        CASE WHEN event_type IN ('view', 'click') THEN 'scan' WHEN event_type = 'purchase' THEN 'embed' ELSE 'summarize' END || ':' || user_id AS dedupe_key,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'running' ELSE 'pending' END AS state,
        user_id % 5 AS priority, CAST(floor(epoch(ts)) AS BIGINT) AS not_before, event_id % 7 AS attempts, event_id % 4 AS parks,
        CASE WHEN event_type = 'error' THEN 'error ' || event_id END AS last_error, CAST(floor(epoch(ts)) AS BIGINT) AS updated_at, props AS payload FROM events)""",
}


def with_views(sql: str, *names: str) -> str:
    """SQL whose WITH list starts with the named views; ``sql`` goes on with its own ones or with SELECT."""
    views = ", ".join(VIEWS_SQL[n] for n in names)
    return f"WITH {views}{'' if sql.lstrip().upper().startswith('SELECT') else ','} {sql}"

"""Sources, sinks and streams over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import scratch, streaming
from corvane.model import Tables, with_views
from corvane.operators import maintenance
from corvane.queries import query
from corvane.sources import logs, snapshots


def _scratch(t: Tables) -> str:
    return scratch.folder(t.spark)


_MERGED = """r AS (SELECT conv_id AS session, turn AS seq, 'm' || (turn // 3) AS message, role, text FROM conversations)"""


def _records(t: Tables) -> DataFrame:
    made = F.struct(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.concat(F.lit("m"), F.floor(F.col("turn") / 3)).alias("message"), "role", "text")
    return logs.parse(t.conversations.select(F.to_json(made).alias("value")))


@query(f"WITH {_MERGED} SELECT session, message, min(seq) AS ordinal, arg_min(role, seq) AS role, count(*) AS parts, sha256(string_agg(text, chr(10) ORDER BY seq)) AS body_sha FROM r GROUP BY 1, 2")
def merged_messages(t: Tables) -> DataFrame:
    return logs.merge_messages(_records(t)).select("session", "message", "ordinal", "role", "parts", F.sha2("body", 256).alias("body_sha"))


@query(f"WITH {_MERGED}, c AS (SELECT session, max(seq) AS done FROM r WHERE seq < 3 AND session % 4 <> 0 GROUP BY 1) SELECT session, seq, role FROM r LEFT JOIN c USING (session) WHERE seq > coalesce(done, -1)")
def resumed_records(t: Tables) -> DataFrame:
    records = _records(t)
    return logs.after(records, logs.cursors(records.where("seq < 3 AND session % 4 <> 0"))).select("session", "seq", "role")


@query("SELECT lang, n, truncated FROM (SELECT lang, count(*) AS n, count(*) OVER () > 3 AS truncated FROM documents GROUP BY lang) ORDER BY n DESC, lang LIMIT 3")
def sql_surface(t: Tables) -> DataFrame:
    return snapshots.ask({"documents": t.documents}, "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang", 3)


@query("SELECT 'documents' AS name, 'doc_id,lang,n_chars,source,text' AS columns, count(*) AS rows FROM documents UNION ALL SELECT 'labels', 'doc_id,quality,toxic', count(*) FROM labels")
def data_dictionary(t: Tables) -> DataFrame:
    return snapshots.dictionary({"documents": t.documents, "labels": t.labels})


@query("SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source_no FROM documents")
def view_dictionary(t: Tables) -> DataFrame:
    return snapshots.encoded(t.documents.select("doc_id", "source"), "source")


@query(with_views("SELECT identity, path, CASE WHEN element_id % 3 = 2 THEN greatest(sha256(path), blob_sha) ELSE blob_sha END AS blob_sha FROM locations", "locations"))
def published_snapshot(t: Tables) -> DataFrame:
    folder = _scratch(t)
    places = t.locations.select("identity", "path", "blob_sha", "element_id")
    # two thirds are published first, then two thirds with other contents, so a third is written over
    later = places.where("element_id % 3 <> 0").withColumn("blob_sha", F.when(F.col("element_id") % 3 == 2, F.sha2("path", 256)).otherwise(F.col("blob_sha")))
    snapshots.publish({"locations": maintenance.upsert(places.where("element_id % 3 <> 1"), later, ["element_id"], "blob_sha")}, folder, "first")
    return snapshots.current(t.spark, folder)["locations"].drop("element_id")


def _stream(t: Tables) -> DataFrame:
    found = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
    b AS (SELECT *, sum(CASE WHEN gap >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
    SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts))) AS BIGINT) AS last_s, count(*) AS n FROM b GROUP BY user_id, burst"""
)
def stream_bursts(t: Tables) -> DataFrame:
    folder = _scratch(t)
    # all of a drained stream is wanted, so the state is written whole; a running one appends what the watermark settles
    streaming.drain(streaming.bursts(_stream(t), "user_id", "ts", "6 hours"), f"{folder}/out", f"{folder}/checkpoint", mode="complete")
    return t.spark.read.parquet(f"{folder}/out").select("user_id", F.unix_timestamp("first").alias("first_s"), F.unix_timestamp("last").alias("last_s"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_ledger(t: Tables) -> DataFrame:
    folder = _scratch(t)
    twice = _stream(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")  # every record is replayed
    streaming.record(twice, ["event_id"], f"{folder}/out", f"{folder}/checkpoint")
    return t.spark.read.parquet(f"{folder}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

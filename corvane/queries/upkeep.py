"""Ignore rules, byte cuts, incremental parsing, passes and the event feed over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import scratch
from corvane.functions import cuts
from corvane.model import Tables, with_views
from corvane.operators import conversations, incremental
from corvane.queries import query
from corvane.sources import ignores, snapshots
from corvane.streaming import events, passes

# Rule files of every repository: at its root, and in the folder of French texts.
RULES = {"": "# texts left out\nd3/\n*7.txt\n!*17.txt\n\n/en/d1/\nes/**/2*.txt\n", "fr": "!d3/\nd5\n"}

_IGNORED_SQL = """judged AS (SELECT identity AS root, path, split_part(path, '/', 1) AS lang, split_part(path, '/', 2) AS dir, split_part(path, '/', 3) AS name FROM locations),
    v AS (SELECT *, (dir = 'd3' AND lang <> 'fr') OR (lang = 'en' AND dir = 'd1') OR (lang = 'fr' AND dir = 'd5') AS in_dir,
        CASE WHEN lang = 'es' AND starts_with(name, '2') THEN TRUE WHEN name LIKE '%17.txt' THEN FALSE ELSE name LIKE '%7.txt' END AS own FROM judged)"""


def _judged(t: Tables, paths: DataFrame) -> DataFrame:
    roots = t.locations.select(F.col("identity").alias("root")).distinct()
    files = roots.select("root", F.explode(F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(x).alias("text")) for d, x in RULES.items()])).alias("f")).select("root", "f.dir", "f.text")
    return ignores.verdicts(paths, ignores.rules(files))


def _paths(t: Tables) -> DataFrame:
    return t.locations.select(F.col("identity").alias("root"), "path")


@query(with_views(f"{_IGNORED_SQL} SELECT root, path, in_dir OR own AS ignored, CASE WHEN in_dir THEN lang || '/' || dir WHEN own THEN path END AS by FROM v", "locations"))
def ignored_paths(t: Tables) -> DataFrame:
    return _judged(t, _paths(t))


@query(with_views(f"{_IGNORED_SQL} SELECT root, lang || '/' || dir AS dir, count(*) AS files FROM v WHERE in_dir GROUP BY ALL", "locations"))
def pruned_directories(t: Tables) -> DataFrame:
    return ignores.pruned(_judged(t, _paths(t)))


@query(with_views(f"{_IGNORED_SQL} SELECT root, path, in_dir OR own AS ignored FROM v WHERE lang = 'fr'", "locations"))
def subtree_verdicts(t: Tables) -> DataFrame:
    return _judged(t, _paths(t).where(F.col("path").startswith("fr/"))).select("root", "path", "ignored")


# Cuts of 600 bytes with 60 in common, told by their bytes: a cut may stand up to three bytes before the 600th.
@query(
    """WITH RECURSIVE d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents),
    c(doc_id, h, n, chunk_no, start, stop) AS (
        SELECT doc_id, h, n, 0, 0, CASE WHEN n <= 600 THEN n ELSE 600 - CASE WHEN substr(h, 1201, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 1199, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 1197, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END END FROM d
        UNION ALL
        SELECT doc_id, h, n, chunk_no + 1, s, CASE WHEN s + 600 >= n THEN n ELSE s + 600 - CASE WHEN substr(h, 2 * (s + 600) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 2 * (s + 600) - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1
            WHEN substr(h, 2 * (s + 600) - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END END
        FROM (SELECT *, stop - 60 - CASE WHEN substr(h, 2 * (stop - 60) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 2 * (stop - 60) - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1
            WHEN substr(h, 2 * (stop - 60) - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END AS s FROM c WHERE stop < n))
    SELECT doc_id, chunk_no, start, stop, sha256(decode(unhex(substr(h, 2 * start + 1, 2 * (stop - start))))) AS chunk_sha FROM c"""
)
def byte_chunks(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.posexplode(cuts.windows(F.col("text"), 600, 60)).alias("chunk_no", "c"))
    return cut.select("doc_id", "chunk_no", "c.start", "c.stop", F.sha2("c.chunk", 256).alias("chunk_sha"))


@query("SELECT doc_id, strlen(text) > 300 AS cut, CASE WHEN strlen(text) > 300 THEN left(text, (SELECT max(i) FROM range(1, 301) r(i) WHERE strlen(left(text, i)) <= 300)::BIGINT) END AS fitted FROM documents")
def fitted_texts(t: Tables) -> DataFrame:
    kept = cuts.fitted(F.col("text"), 150)  # tokens, of which two thirds are filled with three bytes each
    return t.documents.select("doc_id", kept.isNotNull().alias("cut"), kept.alias("fitted"))


def _lines(blobs: DataFrame) -> DataFrame:
    return blobs.select("blob_sha", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _files(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), F.sha2("text", 256).alias("blob_sha"), "text")


# A first run over two thirds of the files, a second over all: it parses what the first has not seen, and a third finds nothing.
@query(
    """WITH b AS (SELECT text, min(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 2 END) AS run FROM documents GROUP BY text)
    SELECT doc_id, 'run' || run AS run, len(string_split(text, chr(10))) AS lines, 0 AS left_over FROM documents JOIN b USING (text)"""
)
def incremental_parse(t: Tables) -> DataFrame:
    folder = scratch.folder(t.spark)
    files = _files(t)
    incremental.run(files.where("doc_id % 3 <> 0"), folder, "run1", "lines-1", _lines)
    incremental.run(files, folder, "run2", "lines-1", _lines)
    again = incremental.run(files, folder, "run3", "lines-1", _lines)
    parsed = snapshots.current(t.spark, folder)[incremental.ELEMENTS].groupBy("blob_sha", "run").agg(F.count("*").alias("lines"))
    return files.join(parsed, "blob_sha").select("doc_id", "run", "lines", F.lit(again).alias("left_over"))


@query(
    """WITH s AS (SELECT DISTINCT text FROM documents WHERE doc_id % 4 = 0)
    SELECT doc_id, CASE WHEN text IN (SELECT text FROM s) THEN 'stored' WHEN row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 THEN 'parse' ELSE 'reuse' END AS step FROM documents"""
)
def parse_plan(t: Tables) -> DataFrame:
    files = _files(t)
    # another version's parse of a blob does not count
    state = files.select("blob_sha", F.when(F.col("doc_id") % 4 == 0, "lines-1").otherwise("lines-0").alias("parser_version"))
    return incremental.plan(files, state, "lines-1").select(F.col("path").cast("long").alias("doc_id"), "step")


@query(with_views("SELECT conv_id, turn_no, sha256(regexp_replace(body, '\\s+$', '')) AS body_sha, 1 + (row_number() OVER (ORDER BY conv_id, turn_no) - 1) // 1000 AS pass FROM turns", "turns"))
def restated_turns(t: Tables) -> DataFrame:
    trimmed = lambda rows: rows.withColumn("body", F.regexp_replace("body", r"\s+$", ""))
    found = passes.run(t.turns.select("conv_id", "turn_no", "body"), ["conv_id", "turn_no"], 1000, trimmed, scratch.folder(t.spark))
    return found.select("conv_id", "turn_no", F.sha2("body", 256).alias("body_sha"), F.col("pass").cast("long"))


@query(
    with_views(
        """f AS (SELECT conv_id, turn_no, length(body) % 3 = 0 AS calls, length(body) % 2 = 0 AS retrieval, length(body) % 3 = 2 AS breaks FROM turns),
        s AS (SELECT *, CASE WHEN calls THEN retrieval WHEN breaks THEN FALSE END AS state, 1 + (dense_rank() OVER (ORDER BY conv_id) - 1) // 500 AS pass FROM f),
        b AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS pending FROM s)
        SELECT conv_id, turn_no, pass, CASE WHEN calls AND retrieval THEN 'retrieval_call' WHEN calls THEN 'tool_call' WHEN NOT breaks AND pending THEN 'retrieval_result' WHEN NOT breaks THEN 'tool_result' ELSE 'work' END AS turn_class FROM b""",
        "turns",
    )
)
def backfilled_classes(t: Tables) -> DataFrame:
    n = F.length("body")
    classes = lambda rows: conversations.classify(rows, n % 3 == 0, n % 2 == 0, n % 3 == 2).select("conv_id", "turn_no", "turn_class")
    found = passes.run(t.turns, ["conv_id"], 500, classes, scratch.folder(t.spark))
    return found.withColumn("pass", F.col("pass").cast("long"))


@query(
    """SELECT -1 AS batch, '{"stream": "corvane-events", "v": 1, "heartbeat_ms": 15000}' AS line
    UNION ALL SELECT 0, '{"v":1,"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","kind":"' || event_type || '","event_id":' || event_id || ',"user_id":' || user_id || '}' FROM events"""
)
def event_feed(t: Tables) -> DataFrame:
    folder = scratch.folder(t.spark)
    found = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    tagged = events.lines(found.withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_type"), "ts", ["event_id", "user_id"])
    events.publish(tagged, f"{folder}/out", f"{folder}/checkpoint")
    return events.feed(t.spark, f"{folder}/out")

"""Ignore rules, byte cuts, incremental parsing, passes, row sources and event feeds on hand-made cases."""

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane import scratch, streaming
from corvane.functions import cuts
from corvane.operators import analytics, incremental, upkeep
from corvane.scratch import folder as scratch_folder
from corvane.sources import ignores, records, snapshots
from corvane.streaming import events, passes

RULES = [
    ("", "# a comment\n\n*.log\n!keep.log\nbuild/\n/top.txt\ndocs/*.md\n**/gen/**\nsrc/**/tmp\n\\#odd\n\\!bang\nv?.bin\n[ab].dat\n[!ab].raw\ntrail.x   \nonly/\na+b.txt\n"),
    ("pkg", "*.txt\n!good.txt\n!build/\n/local.cfg\n"),
    ("pkg/deep", "!*.txt\nbad.txt\n"),
]
CASES = {
    "a.log": "a.log", "x/y/a.log": "x/y/a.log", "keep.log": None, "x/keep.log": None,
    "build/a.c": "build", "x/build/y/a.c": "x/build", "build": None,
    "top.txt": "top.txt", "x/top.txt": None,
    "docs/a.md": "docs/a.md", "docs/x/a.md": None, "x/docs/a.md": None,
    "gen/a": "gen/a", "x/gen/y/b": "x/gen/y", "gen": None,
    "src/tmp": "src/tmp", "src/a/b/tmp/c": "src/a/b/tmp", "tmp": None,
    "#odd": "#odd", "!bang": "!bang", "v1.bin": "v1.bin", "v12.bin": None,
    "a.dat": "a.dat", "c.dat": None, "c.raw": "c.raw", "a.raw": None, "trail.x": "trail.x",
    "only/a": "only", "x/only": None, "a+b.txt": "a+b.txt", "aab.txt": None,
    "pkg/a.txt": "pkg/a.txt", "pkg/good.txt": None, "pkg/build/a.c": None, "pkg/local.cfg": "pkg/local.cfg", "pkg/x/local.cfg": None,
    "pkg/deep/a.txt": None, "pkg/deep/bad.txt": "pkg/deep/bad.txt", "pkg/deep/x/b.txt": None, "pkg/deep/a.log": "pkg/deep/a.log",
}


def test_ignore_rules(spark):
    found = ignores.rules(spark.createDataFrame([("r", d, t) for d, t in RULES], "root string, dir string, text string"))
    paths = spark.createDataFrame([(r, p) for p in CASES for r in ("r", "other")], "root string, path string")
    got = {(r.root, r.path): r.by for r in ignores.verdicts(paths, found).collect()}
    assert {p: got["r", p] for p in CASES} == CASES
    assert not any(got["other", p] for p in CASES)
    below = {r.path: r.by for r in ignores.below(paths.where("root = 'r'"), found, "pkg").collect()}
    assert below == {p: by for p, by in CASES.items() if p.startswith("pkg/")}
    pruned = {r.dir: r.files for r in ignores.pruned(ignores.verdicts(paths, found)).collect()}
    assert pruned == {"build": 1, "x/build": 1, "x/gen/y": 1, "src/a/b/tmp": 1, "only": 1}


def windows_by_hand(text, window, overlap):
    data = text.encode()
    boundary = lambda n: n >= len(data) or data[n] & 0xC0 != 0x80
    out, start = [], 0
    while True:
        stop = min(start + window, len(data))
        while not boundary(stop):
            stop -= 1
        out.append((start, stop, data[start:stop].decode()))
        if stop == len(data):
            return out
        start = stop - overlap
        while not boundary(start):
            start -= 1


def test_byte_windows(spark):
    draw = random.Random(9)
    scripts = ["abc de\n", "éßñ œ", "中文字", "\U0001f600\U0001f680", "a中\U0001f600é"]
    texts = ["", "a", "x" * 40, "x" * 41] + ["".join(draw.choice(draw.choice(scripts)) for _ in range(draw.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for window, overlap in ((40, 10), (17, 10), (40, 0)):
        got = {r.i: [tuple(c) for c in r.w] for r in df.select("i", cuts.windows(F.col("t"), window, overlap).alias("w")).collect()}
        assert got == {i: windows_by_hand(t, window, overlap) for i, t in enumerate(texts)}
    with pytest.raises(ValueError):
        cuts.windows(F.col("t"), 16, 10)
    long = "é" * 100_000
    row = spark.createDataFrame([(long,), (None,)], "t string").select(cuts.windows(F.col("t")).alias("w")).collect()
    assert [tuple(c) for c in row[0].w] == windows_by_hand(long, 15000, 600) and row[1].w is None


def test_fitted(spark):
    texts = ["abc", "abcd", "ab\U0001f600", "\U0001f600a", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    at = lambda cap: [r.f for r in df.select("i", cuts.fitted(F.col("t"), cap).alias("f")).orderBy("i").collect()]
    assert cuts.budget_bytes(7500) == 15000
    assert at(3) == [None, None, None, None, None, None]
    assert at(2) == [None, "abc", "ab", "\U0001f600", None, None]  # three bytes, or one character
    assert at(0) == ["a", "a", "a", "\U0001f600", None, None]


def lines(blobs):
    return blobs.select("blob_sha", F.explode(F.split("text", " ")).alias("word"))


def test_incremental_parse(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, blob_sha string, text string")
    folder = scratch_folder(spark)
    first = files(("a", "1", "x y"), ("b", "1", "x y"), ("c", "2", "z"))
    assert incremental.run(first, folder, "one", "v1", lines) == 2
    assert incremental.run(first, folder, "two", "v1", lines) == 0
    assert incremental.run(first.unionAll(files(("d", "3", "w"))), folder, "three", "v1", lines) == 1
    assert incremental.run(first, folder, "four", "v2", lines) == 2
    held = snapshots.current(spark, folder)
    got = sorted(tuple(r) for r in held[incremental.ELEMENTS].select("blob_sha", "word", "parser_version", "run").collect())
    assert got == [("1", "x", "v1", "one"), ("1", "x", "v2", "four"), ("1", "y", "v1", "one"), ("1", "y", "v2", "four"), ("2", "z", "v1", "one"), ("2", "z", "v2", "four"), ("3", "w", "v1", "three")]
    steps = incremental.plan(files(("e", "9", "q"), ("d", "9", "q"), ("a", "1", "x y")), held[incremental.STATE], "v1")
    assert {r.path: r.step for r in steps.collect()} == {"a": "stored", "d": "parse", "e": "reuse"}
    assert [r.blob_sha for r in incremental.unparsed(files(("a", "3", "w"), ("b", "4", "k")), held[incremental.STATE], "v2").orderBy("blob_sha").collect()] == ["3", "4"]


def test_passes_go_on_after_a_stop(spark):
    rows = spark.createDataFrame([(c, n, c * 100 + n) for c in range(7) for n in range(c + 1)] + [(None, 1, 5)], "conv long, turn long, x long")
    rewrite = lambda part: part.withColumn("x", F.col("x") + 1)
    whole = passes.run(rows, ["conv", "turn"], 5, rewrite, scratch_folder(spark))
    want = sorted(tuple(r) for r in whole.collect())
    assert len(want) == 28 and max(r[-1] for r in want) == 6
    folder = scratch_folder(spark)
    with pytest.raises(ValueError):
        passes.written(spark, folder)

    def killed(part):
        rewrite(part).write.mode("overwrite").parquet(f"{folder}/pass={(passes.cursor(spark, folder) or {'number': 0})['number'] + 1:06d}")
        raise KeyboardInterrupt

    while True:  # every pass is stopped once after its rows were written, before its cursor
        try:
            if not passes.step(rows, ["conv", "turn"], 5, killed, folder):
                break
        except KeyboardInterrupt:
            pass
        before = passes.cursor(spark, folder)
        assert passes.step(rows, ["conv", "turn"], 5, rewrite, folder) > 0
        assert passes.cursor(spark, folder)["number"] == (before or {"number": 0})["number"] + 1
    assert sorted(tuple(r) for r in passes.written(spark, folder).collect()) == want
    groups = passes.run(rows, ["conv"], 3, rewrite, scratch_folder(spark))
    assert {r.conv: r["pass"] for r in groups.collect()} == {c: c // 3 + 1 for c in range(7)}


def test_many_passes_read_their_rows_a_few_times(spark):
    rows, calls = spark.range(100).select("id", (F.col("id") * 2).alias("x")), []
    found = passes.run(rows, ["id"], 2, lambda part: calls.append(1) or part, scratch_folder(spark))
    assert {(r.id, r.x, r["pass"]) for r in found.collect()} == {(i, 2 * i, i // 2 + 1) for i in range(100)}
    assert len(calls) <= 8  # for 50 passes


def test_frames_do_not_reach_to_the_end(spark, monkeypatch):
    """Spark reads such a frame anew for every row of a group."""
    plans, kept = [], scratch.kept
    monkeypatch.setattr(scratch, "kept", lambda df: plans.append(df) or kept(df))
    items = spark.createDataFrame([(i, i % 2, 1 + i % 7) for i in range(40)], "id long, g long, size long")
    plans.append(upkeep.batches(items, "g", "size", 9))
    plans.append(analytics.bracketed(items, "g", ["id"], "size"))
    assert not [p for p in plans if "unboundedfollowing" in p._jdf.queryExecution().optimizedPlan().toString().lower()]


def event(session, kind, message=None, at="t", text="", repo="r"):
    said = {"session": session, "type": kind, "repo": repo, "message": {"id": message, "text": text}}
    return json.dumps(said | ({"timestamp": at} if at else {}))


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "rows.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE events (event_kind INTEGER, tool TEXT, event TEXT)")
        con.executemany(
            "INSERT INTO events VALUES (?, ?, ?)",
            [
                (5, "claude", event("s", "user", at="1", text="ask")),
                (5, "claude", event("s", "assistant", "m1", at=None, text="undated")),
                (5, "claude", event("s", "assistant", "m1", at="3", text="one")),
                (5, "claude", event("s", "assistant", "m2", at="4", text="other")),
                (5, "claude", event("s", "assistant", "m1", at=None, text="two")),
                (5, "claude", event("s", "system", at="6", text="no turn")),
                (5, "other", event("s", "user", at="7", text="other tool")),
                (4, "claude", event("s", "user", at="8", text="other kind")),
                (5, "claude", event("s", "user", at="9", text="other repository", repo="q")),
                (5, "claude", event("s", "user", at=None, text="undated")),
            ],
        )
    return path


def test_row_source(spark, database):
    spark.dataSource.register(records.RowSource)
    load = lambda **o: spark.read.format("sqlite_rows").schema("rowid long, event_kind int, tool string, event string").options(path=database, table="events", **o).load()
    rows = load(range="3")
    assert rows.rdd.getNumPartitions() == 4 and [r.rowid for r in rows.orderBy("rowid").collect()] == list(range(1, 11))
    assert [r.rowid for r in load(after="8").orderBy("rowid").collect()] == [9, 10] and load(after="10").count() == 0
    got = sorted(tuple(r) for r in records.turns(rows, "r").select("ordinal", "role", "at", "parts", "body").collect())
    assert got == [(1, "human", "1", 1, "ask"), (3, "agent", "3", 2, "one\ntwo"), (4, "agent", "4", 1, "other")]
    with pytest.raises(Exception, match="table name"):
        spark.read.format("sqlite_rows").schema("rowid long").options(path=database, table="a; b").load().count()


def test_row_stream_reads_each_row_once(spark, database):
    spark.dataSource.register(records.RowSource)
    folder = scratch_folder(spark)

    def drain():
        stream = spark.readStream.format("sqlite_rows").schema("rowid long, generation string, tool string").options(path=database, table="events", range="4").load()
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(once=True).start()
        query.awaitTermination()
        return sorted((r.generation, r.rowid) for r in spark.read.schema("rowid long, generation string, tool string").parquet(f"{folder}/out").collect())

    first = drain()
    assert [n for _, n in first] == list(range(1, 11))
    assert drain() == first
    with sqlite3.connect(database) as con:
        con.execute("INSERT INTO events VALUES (5, 'late', '{}')")
    assert [n for _, n in drain()] == list(range(1, 12))
    with sqlite3.connect(database) as con:  # written anew
        con.execute("DELETE FROM events")
        con.executemany("INSERT INTO events VALUES (5, ?, '{}')", [("new",)] * 3)
    again = drain()
    assert len(again) == 14 and sorted(n for g, n in again if g != first[0][0]) == [1, 2, 3]


def test_event_feed(spark):
    folder = scratch_folder(spark)
    rows = spark.createDataFrame([("2024-01-02 03:04:05.678", "scan", 3), ("2024-01-02 03:04:05.001", "ask", None)], "at string, k string, n int").withColumn("at", F.col("at").cast("timestamp"))
    batch = events.lines(rows, F.col("k"), "at", ["n"])
    assert [r.line for r in events.feed(spark, folder).collect()] == ['{"stream": "corvane-events", "v": 1, "heartbeat_ms": 15000}']
    assert events.append(batch, 0, folder) and not events.append(batch, 0, folder)
    batch.write.mode("overwrite").parquet(f"{folder}/batch=000000007")  # a batch that was killed before its commit
    assert events.append(batch.limit(1), 1, folder)
    got = [r.line for r in events.feed(spark, folder).where("batch = 0").collect()]
    assert sorted(got) == ['{"v":1,"at":"2024-01-02T03:04:05.001Z","kind":"ask"}', '{"v":1,"at":"2024-01-02T03:04:05.678Z","kind":"scan","n":3}']
    assert events.feed(spark, folder).count() == 4
    assert [list(json.loads(x)) for x in [events.greeting()]] == [["stream", "v", "heartbeat_ms"]]
    beats = events.heartbeats(spark, 1)
    query = beats.writeStream.format("memory").queryName("beats").trigger(once=True).start()
    query.awaitTermination()
    assert all(json.loads(r.line)["kind"] == "heartbeat" for r in spark.table("beats").collect())


def test_ledger_remembers_for_good(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    add = lambda rows: spark.createDataFrame(rows, "id long, at string").coalesce(1).write.mode("append").parquet(source)
    add([(1, "2020-01-01"), (1, "2020-01-01"), (2, "2024-01-01")])
    run = lambda: streaming.record(spark.readStream.schema("id long, at string").parquet(source), ["id"], out, checkpoint)
    run()
    add([(1, "2020-01-01"), (3, "2024-06-01")])  # a replay years behind the newest record
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]

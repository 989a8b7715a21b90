"""Discovery, logs, snapshots and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvane import streaming
from corvane.sources import discovery, logs, snapshots


def test_discovery(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "b.json": b"{}", "c.rs": b"\0\1", "i.py": b"0\n\0", "k.py": b"0 0\x10\x01", "d.xyz": b"?", "node_modules/g.js": b"z", "sub/h.py": b"w"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.skip_reason for r in discovery.discover(spark, str(tmp_path)).collect()}
    assert got == {"a.py": None, "b.json": "config-format", "c.rs": "binary", "i.py": "binary", "k.py": None, "d.xyz": "unsupported-extension", "node_modules/g.js": "pruned", "sub/h.py": None}
    listed = spark.createDataFrame([("e.md", 0, b""), (".hid/f.py", 1, b"y")], "path string, length long, content binary")
    assert {r.path: r.skip_reason for r in discovery.verdicts(listed).collect()} == {"e.md": "too-small", ".hid/f.py": "hidden"}


def test_messages_merge_and_resume(spark):
    rows = [{"session": 1, "seq": s, "message": m, "role": "user", "text": t} for s, m, t in ((1, "a", "x"), (2, "a", "y"), (3, "b", "z"))]
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("",), ("{torn",)], "value string")
    records = logs.parse(lines)
    got = {r.message: (r.ordinal, r.parts, r.body) for r in logs.merge_messages(records).collect()}
    assert got == {"a": (1, 2, "x\ny"), "b": (3, 1, "z")}
    assert logs.after(records, logs.cursors(records.where("seq < 3"))).count() == 1
    assert logs.after(records, logs.cursors(records)).count() == 0


def test_snapshot_is_published_whole(spark, tmp_path):
    df = spark.range(5)
    snapshots.publish({"t": df}, f"file://{tmp_path}", "one")
    snapshots.publish({"t": df.where("id < 2")}, f"file://{tmp_path}", "two")
    assert snapshots.current(spark, f"file://{tmp_path}")["t"].count() == 2
    with pytest.raises(ValueError):
        snapshots.publish({"t": df}, f"file://{tmp_path}", "../x")
    assert [r.truncated for r in snapshots.ask({"t": df}, "SELECT * FROM t", 3).collect()] == [True] * 3


def test_tail_and_replay(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = StructType.fromDDL("id long, at timestamp")

    def add(name, ids):
        (source / name).write_text("".join(json.dumps({"id": i, "at": "2024-01-01T00:00:00Z"}) + "\n" for i in ids) + "\n")

    def drain():
        stream = streaming.unseen(streaming.tail(spark, str(source), schema), ["id"], "at")
        streaming.drain(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("id")).collect())

    add("a.jsonl", [1, 2])
    assert drain() == [1, 2]
    add("b.jsonl", [2, 3])  # a rotated file replays what was seen
    assert drain() == [1, 2, 3]


def test_complete_mode_keeps_the_last_state_only(spark, tmp_path):
    """Two drains of one stream: the second state, which counts all, takes the place of the first."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for n, values in enumerate(([1, 1, 2], [2, 3])):
        (folder / f"{n}.jsonl").write_text("\n".join(json.dumps({"k": v}) for v in values) + "\n")
        counted = streaming.tail(spark, str(folder), StructType.fromDDL("k long")).groupBy("k").agg(F.count("*").alias("n"))
        streaming.drain(counted, str(out), str(tmp_path / "checkpoint"), mode="complete")
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(out)).collect()) == [(1, 2), (2, 2), (3, 1)]


def test_manifest_is_replaced(spark, tmp_path):
    for name, n in (("first", 1), ("second", 2)):
        snapshots.publish({"rows": spark.range(n)}, str(tmp_path), name)
        assert snapshots.current(spark, str(tmp_path))["rows"].count() == n

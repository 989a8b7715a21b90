"""Rows of an SQLite table as a Spark source: by ranges of rowid, in batches or as a stream behind a cursor.

    spark.dataSource.register(RowSource)
    spark.readStream.format("sqlite_rows").schema("event string").option("path", p).option("table", "events").load()

Every row has its ``rowid`` and the table's ``generation`` besides the columns of the schema.
"""

from __future__ import annotations

import hashlib
import sqlite3
from collections.abc import Iterator
from contextlib import closing

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a partition.
RANGE = 50_000
#: The event kind that is a conversation, the tool, and the record types that are turns, with their role.
EVENT_KIND, TOOL, ROLES = 5, "claude", {"user": "human", "assistant": "agent"}


class Range(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Table:
    """The table behind a source's options; files have to be where every executor can open them."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("range", RANGE))
        if not self.table.isidentifier():
            raise ValueError(f"{self.table!r} is no table name")
        self.columns = [f.name for f in schema.fields]

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def state(self) -> tuple[str, int]:
        """The generation (a hash of the first row, which appending leaves as it is) and the last rowid."""
        with closing(self._connect()) as con:
            first = con.execute(f"SELECT rowid, * FROM {self.table} ORDER BY rowid LIMIT 1").fetchone()
            last = con.execute(f"SELECT max(rowid) FROM {self.table}").fetchone()[0]
        return hashlib.sha256(repr(first).encode()).hexdigest()[:16] if first else "", last or 0

    def ranges(self, after: int, last: int) -> list[Range]:
        return [Range(n + 1, min(n + self.rows, last)) for n in range(after, last, self.rows)]

    def read(self, part: Range) -> Iterator[tuple]:
        generation = self.state()[0]
        names = ", ".join({"rowid": "rowid", "generation": "?"}.get(c, f'"{c}"') for c in self.columns)
        given = [generation] if "generation" in self.columns else []
        with closing(self._connect()) as con:
            yield from con.execute(f"SELECT {names} FROM {self.table} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", [*given, part.first, part.last])


class BatchReader(DataSourceReader):
    def __init__(self, table: _Table, after: int) -> None:
        self.table, self.after = table, after

    def partitions(self) -> list[Range]:
        return self.table.ranges(self.after, self.table.state()[1]) or [Range(1, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.table.read(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are the generation and the last rowid read. A table that was written anew has another generation and is read from its start."""

    def __init__(self, table: _Table) -> None:
        self.table = table

    def initialOffset(self) -> dict:
        return {"generation": "", "row": 0}

    def latestOffset(self) -> dict:
        generation, last = self.table.state()
        return {"generation": generation, "row": last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        same = start["generation"] == end["generation"] and start["row"] <= end["row"]
        return self.table.ranges(start["row"] if same else 0, end["row"]) or [Range(1, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.table.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: the checkpoint holds the cursor."""


class RowSource(DataSource):
    """Options: path, table, range (rows of a partition) and, for batches, after (a rowid to start behind)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        raise ValueError("a schema has to be given: the table's columns, and rowid and generation where they are wanted")

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(_Table(schema, self.options), int(self.options.get("after", 0)))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(_Table(schema, self.options))


def turns(rows: DataFrame, repository: str) -> DataFrame:
    """session, ordinal, role, at, parts and body of the turns in (rowid, event_kind, tool, event): JSON events of one repository.

    Only records of a person or of the assistant are turns. Those of one ``message.id`` are one turn, at the
    place and time of the first that has a time; records without an id are turns of their own. A turn without any time is none.
    """
    said = lambda path: F.get_json_object("event", path)
    kept = rows.where((F.col("event_kind") == EVENT_KIND) & (F.col("tool") == TOOL) & (said("$.repo") == repository))
    role = F.coalesce(*[F.when(said("$.type") == k, v) for k, v in ROLES.items()])
    each = kept.select("rowid", said("$.session").alias("session"), role.alias("role"), said("$.message.id").alias("message"), said("$.timestamp").alias("at"), F.coalesce(said("$.message.text"), F.lit("")).alias("text"))
    each = each.where("role IS NOT NULL").withColumn("group", F.coalesce("message", F.concat(F.lit("row "), "rowid")))
    first = F.min(F.when(F.col("at").isNotNull(), F.struct("rowid", "at", "role")))
    parts = F.array_sort(F.collect_list(F.struct("rowid", "text", "at")))
    merged = each.groupBy("session", "group").agg(first.alias("first"), parts.alias("parts")).where("first IS NOT NULL")
    # what came before the turn's first dated record could not open it and is no part of it
    held = F.filter("parts", lambda p: p["rowid"] >= F.col("first.rowid"))
    texts = F.filter(F.transform(held, lambda p: p["text"]), lambda x: x != "")
    return merged.select("session", F.col("first.rowid").alias("ordinal"), "first.role", "first.at", F.size(held).alias("parts"), F.array_join(texts, "\n").alias("body"))

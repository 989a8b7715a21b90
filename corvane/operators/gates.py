"""Structured documents: gates, derived completion, references and enrichment rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States in which an entry of a group is done. Fixed values.
TERMINAL = ("done", "dropped", "accepted", "rejected", "superseded", "closed")


def gate_open(rows: DataFrame, wanted_open: bool, derived: Column, gate: Column) -> DataFrame:
    """Rows whose gate is as wanted: derived completion counts before the stored gate, and what is unknown never matches."""
    shut = F.coalesce(derived, gate)
    return rows.where(shut.isNotNull() & (shut == F.lit(not wanted_open)))


def derived_state(entries: DataFrame, group: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """group, complete and the ids that are not: a group is complete if no entry is outside the terminal states."""
    left = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("state").isin(*terminal), F.col("id")))), lambda x: x.cast("string")), ",")
    return entries.groupBy(group).agg(F.count_if(~F.col("state").isin(*terminal)).alias("n"), left.alias("incomplete")).select(group, (F.col("n") == 0).alias("complete"), "incomplete")


def without_container_files(elements: DataFrame) -> DataFrame:
    """Elements but for files that have children, which stand for themselves."""
    parents = elements.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct()
    return elements.where("kind <> 'file'").unionByName(elements.where("kind = 'file'").join(parents, "id", "left_anti"))


def wants_summary(kind: Column, text: Column, lines: Column, floor: int = 10) -> Column:
    """Whether an element is summarised: not blank, no file, and long enough."""
    return (F.trim(text) != "") & (kind != "file") & (lines >= floor)


def preferred_summaries(summaries: DataFrame, key: str, models: list[str]) -> DataFrame:
    """Of each text the summary of the first model in order of preference, then the oldest."""
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    order = Window.partitionBy(key).orderBy(F.when(place == 0, len(models) + 1).otherwise(place), "created", "model")
    return summaries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def work_vectors(elements: DataFrame, summaries: DataFrame, vectors: DataFrame) -> DataFrame:
    """id and vector_id: the vector of an element's summary, else of its own text."""
    smart = summaries.join(vectors.select(F.col("source_hash").alias("text_hash"), F.col("vector_id").alias("smart_id")), "text_hash").groupBy("raw_hash").agg(F.min("smart_id").alias("smart_id"))
    raw = vectors.groupBy(F.col("source_hash").alias("raw_hash")).agg(F.min("vector_id").alias("raw_id"))
    joined = elements.join(smart, "raw_hash", "left").join(raw, "raw_hash", "left")
    return joined.select("id", F.coalesce("smart_id", "raw_id").alias("vector_id"))


def stop_rule(text: Column) -> Column:
    """Why a turn's text counts as boilerplate, or null."""
    plain = F.ltrim(text)
    return (
        F.when(F.trim(text) == "", "empty")
        .when(plain.startswith("<local-command-caveat>"), "local_command_caveat")
        .when((F.trim(text) == "/compact") | text.contains("<command-name>/compact</command-name>"), "compact")
        .when(plain.startswith("<task-notification>"), "task_notification")
    )


def cached_scope(cached: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A cached set brought up to date by what changed since: its latest state in ``changes`` (key, held, version) counts."""
    last = changes.groupBy(key).agg(F.max_by("held", "version").alias("held"))
    kept = cached.select(key).join(last.where("NOT held"), key, "left_anti")
    return kept.unionByName(last.where("held").select(key)).distinct()


def conversation_guid(seed: Column) -> Column:
    """A stable identifier of the shape of a UUID of version 8."""
    h = F.sha2(seed, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid_version(guid: Column) -> Column:
    return F.substring(F.split(guid, "-")[2], 1, 1)

"""Transitions of jobs, removal of roots and conversations, cursors, and where a hit comes to lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters of an error that a job keeps.
ERROR_CHARS = 2000


def park(jobs: DataFrame, now: int, delay: Column) -> DataFrame:
    """Jobs put off for ``delay`` seconds without the attempt counting; each park does."""
    return jobs.withColumns(
        {
            "state": F.lit("pending"),
            "not_before": F.lit(now) + delay,
            "attempts": F.greatest(F.col("attempts") - 1, F.lit(0)),
            "parks": F.col("parks") + 1,
            "updated_at": F.lit(now).cast("long"),
        }
    )


def retry(jobs: DataFrame, now: int, delay: Column, error: Column) -> DataFrame:
    """Jobs to be tried again after ``delay`` seconds, with the error that stopped them."""
    return jobs.withColumns({"state": F.lit("pending"), "last_error": F.left(error, F.lit(ERROR_CHARS)), "not_before": F.lit(now) + delay, "updated_at": F.lit(now).cast("long")})


def release(jobs: DataFrame, now: int, reason: str, refund: bool) -> DataFrame:
    """All jobs, the running ones pending again; ``refund`` takes their attempt back, as at a clean shutdown."""
    running = F.col("state") == "running"
    attempts = F.greatest(F.col("attempts") - 1, F.lit(0)) if refund else F.col("attempts")
    set_ = lambda c, v: F.when(running, v).otherwise(F.col(c))
    return jobs.withColumns({"attempts": set_("attempts", attempts), "last_error": set_("last_error", F.lit(reason)), "updated_at": set_("updated_at", F.lit(now).cast("long")), "state": set_("state", F.lit("pending"))})


def remaining(jobs: DataFrame) -> DataFrame:
    """kind and n of the jobs that still have to end."""
    return jobs.where(F.col("state").isin("pending", "running")).groupBy("kind").agg(F.count("*").alias("n"))


def chain(files: DataFrame, worktrees: DataFrame, repos: DataFrame) -> DataFrame:
    """Files with their worktree's root and their repository; a file of neither is no place. Spark broadcasts small sides itself."""
    return files.join(worktrees, "worktree_id").join(repos, "repo_id")


def anchored(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """blob_sha, identity and root_path: of the conversations that hold a content, the first by repository and worktree, nulls last."""
    rows = turns.join(conversations, "conv_id").select("blob_sha", "identity", "root_path")
    order = Window.partitionBy("blob_sha").orderBy(F.col("identity").asc_nulls_last(), F.col("root_path").asc_nulls_last())
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def resolved(hits: DataFrame, live: DataFrame, anchors: DataFrame, key: str = "raw_hash", scoped: bool = True) -> DataFrame:
    """Hits with the place of their content: a live file's, else its conversation's. Scoped hits without any are dropped."""
    l = live.select(F.col("blob_sha").alias(key), F.col("identity").alias("li"), F.col("root_path").alias("lr"), "path")  # noqa: E741
    a = anchors.select(F.col("blob_sha").alias(key), F.col("identity").alias("ai"), F.col("root_path").alias("ar"))
    found = hits.join(l, key, "left").join(a, key, "left").withColumns({"identity": F.coalesce("li", "ai"), "root_path": F.coalesce("lr", "ar")}).drop("li", "lr", "ai", "ar")
    return found.where(F.coalesce("identity", "root_path", "path").isNotNull()) if scoped else found


def split_address(addresses: DataFrame, identities: DataFrame, rest: Column) -> DataFrame:
    """Adds identity and tail: the longest known identity that is a whole-segment prefix of ``rest``, by a join on its prefixes."""
    parts = F.split(rest, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    tried = addresses.withColumn("__rest", rest).withColumn("identity", F.explode(prefixes)).join(identities.select("identity").distinct(), "identity")
    keys = addresses.columns
    best = tried.groupBy(*keys, "__rest").agg(F.max_by("identity", F.length("identity")).alias("identity"))
    return best.select(*keys, "identity", F.expr("substring(__rest, length(identity) + 2)").alias("tail"))


def root_removals(places: DataFrame) -> DataFrame:
    """root_path, identity, files, repo_removed and orphans: what the removal of each root takes with it.

    A repository goes with its last root; a content is orphaned if no other root holds it.
    """
    roots = places.groupBy("root_path", "identity").agg(F.count("*").alias("files"))
    last = roots.withColumn("repo_removed", F.count("*").over(Window.partitionBy("identity")) == 1)
    holders = places.select("blob_sha", "root_path").distinct().groupBy("blob_sha").agg(F.count("*").alias("n"), F.first("root_path").alias("root_path"))
    orphans = holders.where("n = 1").groupBy("root_path").agg(F.count("*").alias("orphans"))
    return last.join(orphans, "root_path", "left").withColumn("orphans", F.coalesce("orphans", F.lit(0)))


def conversation_removals(turns: DataFrame) -> DataFrame:
    """conv_id, turns, freed and spared: contents that go with a conversation, and those another one shares."""
    contents = turns.select("conv_id", "blob_sha").distinct()
    shared = contents.groupBy("blob_sha").agg((F.count("*") > 1).alias("shared"))  # a row a content, however many hold it
    kinds = contents.join(shared, "blob_sha").groupBy("conv_id").agg(F.count_if(~F.col("shared")).alias("freed"), F.count_if("shared").alias("spared"))
    return turns.groupBy("conv_id").agg(F.count("*").alias("turns")).join(kinds, "conv_id")


def commit_cursors(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """harness, session, conversation, position and refused: a session never moves to another conversation; its cursor advances otherwise."""
    held = stored.select("harness", "session", F.col("conversation").alias("was"), F.col("position").alias("at"))
    both = held.join(offered, ["harness", "session"], "full")
    refused = F.coalesce(F.col("was") != F.col("conversation"), F.lit(False))
    position = F.when(refused | F.col("position").isNull(), F.col("at")).otherwise(F.greatest("position", F.coalesce("at", "position")))
    return both.select("harness", "session", F.coalesce("was", "conversation").alias("conversation"), position.alias("position"), refused.alias("refused"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with the side."""
    return a.distinct().join(b, a.columns, "left_anti").withColumn("side", F.lit("a")).unionAll(b.distinct().join(a, a.columns, "left_anti").withColumn("side", F.lit("b")))


def seed_turns(turns: DataFrame, appended_from: DataFrame) -> DataFrame:
    """conv_id, turn_no and turn_class of the last turn before the one from which each conversation is appended to."""
    before = turns.join(appended_from, "conv_id").where(F.col("turn_no") < F.col("from_turn"))
    return before.groupBy("conv_id").agg(F.max("turn_no").alias("turn_no"), F.max_by("turn_class", "turn_no").alias("turn_class"))


def at_playhead(spans: DataFrame, at: Column) -> DataFrame:
    """Adds exists (begun) and live (begun and not over) at a moment."""
    exists = F.col("started") <= at
    return spans.withColumns({"exists": exists, "live": exists & (at <= F.col("last"))})


def matching(rows: DataFrame, sets: dict[str, list], text: str = "", fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows in every set that is not empty, and whose fields together hold the text in either case."""
    for column, values in sets.items():
        rows = rows.where(F.col(column).isin(values)) if values else rows
    wanted = text.strip().lower()
    return rows.where(F.lower(F.concat_ws("\n", *fields)).contains(wanted)) if wanted else rows

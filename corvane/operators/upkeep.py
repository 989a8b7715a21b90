"""What is missing, what is still referred to, what arrived late, and what a settled directory has changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane import scratch
from corvane.operators.provenance import path_prefix


def missing_summaries(elements: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """id and raw_hash: of each text without a summary by the model one element, the first by id, to summarise it from."""
    done = summaries.where(F.col("model") == model).select("raw_hash")
    return elements.groupBy("raw_hash").agg(F.min("id").alias("id")).join(done, "raw_hash", "left_anti").select("id", "raw_hash")


def vectors_at_hand(hashes: DataFrame, vectors: DataFrame, model: str, source_kind: str) -> DataFrame:
    """Different source_hash among ``hashes`` that have a vector of the model and kind, so that they need not be embedded."""
    held = vectors.where((F.col("model") == model) & (F.col("source_kind") == source_kind)).select("source_hash")
    return hashes.select("source_hash").distinct().join(held, "source_hash", "left_semi")


def outdated_roots(places: DataFrame, elements: DataFrame, version: str) -> DataFrame:
    """root_path of the trees that hold a blob which older parsers have parsed and this version has not."""
    parsed = elements.select("blob_sha", "parser_version")
    stale = parsed.where(F.col("parser_version") != version).join(parsed.where(F.col("parser_version") == version).select("blob_sha"), "blob_sha", "left_anti")
    return places.join(stale, "blob_sha", "left_semi").select("root_path").distinct()


def referred(hashes: DataFrame, elements: DataFrame, summaries: DataFrame) -> DataFrame:
    """hash with by_element and by_summary: whether a text with it is an element's, or the text of a summary of an element's; what neither holds may be collected."""
    raw = elements.select(F.col("raw_hash").alias("hash"), F.lit(True).alias("by_element")).distinct()
    smart = summaries.join(elements.select("raw_hash").distinct(), "raw_hash", "left_semi").select(F.col("text_hash").alias("hash"), F.lit(True).alias("by_summary")).distinct()
    flags = hashes.select("hash").distinct().join(raw, "hash", "left").join(smart, "hash", "left")
    return flags.select("hash", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("by_element", "by_summary")])


def deliveries(sent: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, sent, stored, last_at and arrived of what was sent (conv_id, n) against the turns (conv_id, at) that are stored."""
    held = turns.groupBy("conv_id").agg(F.count("*").alias("stored"), F.max("at").alias("last_at"))
    rows = sent.join(held, "conv_id", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    return rows.select("conv_id", F.col("n").alias("sent"), "stored", "last_at", (F.col("stored") >= F.col("n")).alias("arrived"))


def late_enrichment(turns: DataFrame, summaries: DataFrame, vectors: DataFrame, since) -> DataFrame:
    """conv_id of conversations of which a turn (conv_id, raw_hash) got a summary (raw_hash, at) or vector (source_hash, at) after ``since``."""
    fresh = summaries.where(F.col("at") > since).select("raw_hash").union(vectors.where(F.col("at") > since).select(F.col("source_hash").alias("raw_hash"))).distinct()
    return turns.join(fresh, "raw_hash", "left_semi").select("conv_id").distinct()


def relisted(directory: str, listed: DataFrame, known: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a settled directory asks for, and the map of paths as it is afterwards.

    ``listed`` and ``known`` are (path, blob_sha), the first as the directory is now, the second as it was recorded for the whole tree. A changed path
    (path, blob_sha, change) is new, edited or removed; of new and edited ones, one path for each blob that is not ``parsed``
    yet has a job. Only the part of the map below the directory is written anew.
    """
    below = path_prefix(F.col("path"), directory)
    now, before = listed.where(below), known.where(below).select("path", F.col("blob_sha").alias("was"))
    both = now.join(before, "path", "full_outer")
    change = F.when(F.col("blob_sha").isNull(), "removed").when(F.col("was").isNull(), "new").when(F.col("blob_sha") != F.col("was"), "edited")
    changed = both.withColumn("change", change).where("change IS NOT NULL")
    fresh = changed.where("change <> 'removed'").join(parsed.select("blob_sha", F.lit(True).alias("held")).distinct(), "blob_sha", "left")
    first = F.row_number().over(Window.partitionBy("blob_sha").orderBy("path")) == 1
    jobs = fresh.select("path", (F.col("held").isNull() & first).alias("job"))
    steps = changed.join(jobs, "path", "left").select("path", F.coalesce("blob_sha", "was").alias("blob_sha"), "change", F.coalesce("job", F.lit(False)).alias("job"))
    return steps, known.where(~below).select("path", "blob_sha").unionByName(now.select("path", "blob_sha"))


def attached(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (from_file, from_location, to_file, to_location) with the ids of the nodes (id, file, location) at both ends, and those without one, with the end that is missing."""
    at = lambda side: nodes.select(F.col("file").alias(f"{side}_file"), F.col("location").alias(f"{side}_location"), F.col("id").alias(f"{side}_id"))
    both = edges.join(at("from"), ["from_file", "from_location"], "left").join(at("to"), ["to_file", "to_location"], "left")
    gone = F.when(F.col("from_id").isNull() & F.col("to_id").isNull(), "both").when(F.col("from_id").isNull(), "from").otherwise("to")
    lost = both.where("from_id IS NULL OR to_id IS NULL").withColumn("missing", gone)
    return both.where("from_id IS NOT NULL AND to_id IS NOT NULL"), lost.select("from_file", "from_location", "to_file", "to_location", "missing")


def settled_identities(conversations: DataFrame) -> DataFrame:
    """conv_id, old and new for conversations (conv_id, identity, worktree, at) whose repository has to be renamed.

    The newest identity that is known of a worktree is right for all its conversations; one without a worktree keeps what it has.
    """
    newest = Window.partitionBy("worktree").orderBy(F.col("identity").isNull(), F.desc("at"), F.desc("conv_id"))
    right = conversations.where("worktree IS NOT NULL").withColumn("n", F.row_number().over(newest)).where("n = 1 AND identity IS NOT NULL").select("worktree", F.col("identity").alias("new"))
    rows = conversations.join(right, "worktree")
    return rows.where(~F.col("identity").eqNullSafe(F.col("new"))).select("conv_id", F.col("identity").alias("old"), "new")


def batches(items: DataFrame, group: str, size: str, cap: int) -> DataFrame:
    """Adds batch, from 0: consecutive items (id) of a group whose sizes stay within ``cap`` together; a larger item is a batch of its own.

    A batch closes before the item that would exceed the cap, so where it starts depends on all before it. But
    each item has one place where the next batch would start if it started one, found by running sums. Jumps of
    twice the length in every round mark all starts in as many rounds as the logarithm of the batches; no fold holds a group.
    """
    order = Window.partitionBy(group).orderBy("id")
    sums = items.withColumn("__upto", F.sum(size).over(order)).withColumn("__n", F.row_number().over(order))
    sums = scratch.kept(sums.withColumn("__reach", F.col("__upto") - F.col(size) + cap))
    # an item's reach lies among the running sums: the first sum beyond it is where the next batch starts
    none = F.lit(None).cast("int")
    marks = sums.select(group, F.col("__upto").alias("__at"), F.col("__n").alias("__to"), none.alias("__from")).unionAll(sums.select(group, "__reach", none, "__n"))
    # where both are equal the sum comes first, so that it is within reach; from the end on, as a frame that reaches to the end is read anew for each row
    ahead = Window.partitionBy(group).orderBy(F.desc("__at"), F.col("__from").isNotNull().desc(), F.coalesce("__to", "__from").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = marks.withColumn("__next", F.last("__to", ignorenulls=True).over(ahead)).where("__from IS NOT NULL AND __next IS NOT NULL")
    # an item beyond the cap by itself would point before its own end
    jumps = scratch.kept(found.select(group, "__from", F.greatest(F.col("__next"), F.col("__from") + 1).alias("__next")))
    starts = scratch.kept(sums.where("__n = 1").select(group, F.col("__n").alias("__from")))
    while not jumps.isEmpty():
        reached = starts.join(jumps, [group, "__from"]).select(group, F.col("__next").alias("__from"))
        starts = scratch.kept(starts.union(reached).distinct())
        further = jumps.withColumnRenamed("__next", "__over").join(jumps.select(group, F.col("__from").alias("__over"), "__next"), [group, "__over"])
        jumps = scratch.kept(further.select(group, "__from", "__next"))
    marked = sums.join(starts.withColumnRenamed("__from", "__n").withColumn("__starts", F.lit(1)), [group, "__n"], "left")
    return marked.withColumn("batch", F.sum(F.coalesce("__starts", F.lit(0))).over(order) - 1).select(*items.columns, "batch")

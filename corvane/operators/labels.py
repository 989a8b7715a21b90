"""Tags and turns that stand for a conversation or a community."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters from which a summary describes something.
BODY = 40


def representatives(turns: DataFrame, ranked: DataFrame) -> DataFrame:
    """conv_id, turn_no and score of each conversation's representative turn.

    Turns (conv_id, turn_no, summary, tags, centrality) score 3, 2 and 1 for holding the conversation's first three tags
    (``ranked``: conv_id, tag, rank) and twice their centrality; of equal ones a summary of some length goes first, then the earliest.
    A turn without summary cannot stand for its conversation.
    """
    focus = ranked.where("rank <= 3").groupBy("conv_id").agg(F.collect_list(F.struct("tag", (F.lit(4) - F.col("rank")).alias("w"))).alias("focus"))  # three at most
    held = F.aggregate("focus", F.lit(0), lambda s, f: s + F.when(F.array_contains("tags", f["tag"]), f["w"]).otherwise(0).cast("int"))
    score = (F.coalesce(held, F.lit(0)) + 2.0 * F.coalesce("centrality", F.lit(0.0))).alias("score")
    rows = turns.where("summary IS NOT NULL").join(focus, "conv_id", "left").select("conv_id", "turn_no", score, (F.length("summary") >= BODY).alias("body"))
    best = F.max_by(F.struct("turn_no", "score"), F.struct("score", "body", -F.col("turn_no"))).alias("best")
    return rows.groupBy("conv_id").agg(best).select("conv_id", "best.turn_no", "best.score")


def community_tags(tagged: DataFrame, most: int = 6, sharp: float = 2.0) -> DataFrame:
    """community, tag, rank and score of the tags that set communities apart, from rows (community, member, tag), repeats included.

    A tag's share in the community over its share in all is its lift; those above 1 are ranked, lifts of ``sharp`` or more
    first, by share × ln(lift) × (¼ + the part of members that carry it), then by name. A tag of equal share everywhere has no rank.
    """
    pairs = tagged.groupBy("community", "member", "tag").agg(F.count("*").alias("n"))
    counts = pairs.groupBy("community", "tag").agg(F.sum("n").alias("n"), F.count("*").alias("carriers"))
    sizes = tagged.groupBy("community").agg(F.count("*").alias("total"), F.count_distinct("member").alias("members"))
    return _apart(counts, sizes, most, sharp)


def listed_community_tags(listed: DataFrame, most: int = 6, sharp: float = 2.0) -> DataFrame:
    """:func:`community_tags` from rows (community, member, tags), a member's tags in one list, repeats included.

    Where no member has several rows, a row's tags and carried tags are counted where it is read, and only sums are shuffled.
    """
    several = listed.groupBy("community", "member").agg(F.count("*").alias("n")).where("n > 1 OR member IS NULL")
    if not several.isEmpty():
        return community_tags(listed.select("community", "member", F.explode("tags").alias("tag")), most, sharp)
    one = lambda tags, n, carriers: F.transform(tags, lambda x: F.struct(x.alias("tag"), F.lit(n).alias("n"), F.lit(carriers).alias("carriers")))
    each = listed.select("community", F.explode(F.concat(one("tags", 1, 0), one(F.array_distinct("tags"), 0, 1))).alias("x"))
    counts = each.groupBy("community", "x.tag").agg(F.sum("x.n").alias("n"), F.sum("x.carriers").alias("carriers"))
    sizes = listed.where(F.size("tags") > 0).groupBy("community").agg(F.sum(F.size("tags")).alias("total"), F.count("*").alias("members"))
    return _apart(counts, sizes, most, sharp)


def _apart(counts: DataFrame, sizes: DataFrame, most: int, sharp: float) -> DataFrame:
    corpus = counts.groupBy("tag").agg(F.sum("n").alias("corpus"))
    whole = sizes.agg(F.sum("total").alias("whole"))  # one row
    rows = counts.join(sizes, "community").join(corpus, "tag").crossJoin(F.broadcast(whole))
    share = F.col("n") / F.col("total")
    lift = share / (F.col("corpus") / F.col("whole"))
    rows = rows.select("community", "tag", share.alias("share"), lift.alias("lift"), (F.col("carriers") / F.col("members")).alias("cover")).where("lift > 1")
    rows = rows.withColumn("score", F.round(F.col("share") * F.log("lift") * (0.25 + F.col("cover")), 9))
    rank = F.row_number().over(Window.partitionBy("community").orderBy((F.col("lift") >= sharp).desc(), F.desc("score"), "tag"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("community", "tag", "rank", "score")

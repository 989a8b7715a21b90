"""Fusion of the lexical and the vector leg, balance per source, pages and tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hits that one conversation and one file may hold before the rest move below.
CONVERSATION_CAP, FILE_CAP = 2, 1
#: A person's restatement of the question scores no more than this.
RESTATED_CEILING = 0.45


def corroborated(left: Column, right: Column) -> Column:
    """The score of a hit found by both legs: the better one and a tenth of the other, 1 at most."""
    both = F.greatest(left, right) + 0.1 * F.greatest(F.least(left, right), F.lit(0.0))
    return F.least(both, F.lit(1.0))


def damped(score: Column, kind: Column, source: Column, text: Column, query: str) -> Column:
    """Caps a human turn that is little more than the query itself."""
    asked = query.strip().lower()
    restates = (kind == "turn") & (source == "human") & (F.octet_length(text) < 4 * len(asked.encode())) & F.lower(text).contains(asked)
    return F.when(restates & F.lit(bool(asked)), F.least(score, F.lit(RESTATED_CEILING))).otherwise(score)


def fuse_hits(lexical: DataFrame, semantic: DataFrame, key: list[str]) -> DataFrame:
    """As :func:`fuse`, for hits that several columns name together, such as address, worktree, path and span; nulls are alike."""
    packed = lambda leg: leg.select(F.struct(*key).alias("hit"), "score", "rank")
    return fuse(packed(lexical), packed(semantic), "hit").select("hit.*", "channel", "score", "rank")


def fuse(lexical: DataFrame, semantic: DataFrame, key: str = "id") -> DataFrame:
    """Both legs' hits in one ranking: key, channel, score and rank.

    Each leg has key, score and rank; of a leg's repeated key the first counts. Equal scores keep
    the order lexical first, then semantic, each by its own rank.
    """
    first = lambda leg: leg.groupBy(key).agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    left = first(lexical).select(F.col(key).alias("__l"), F.col("score").alias("ls"), F.col("rank").alias("lr"))
    right = first(semantic).select(F.col(key).alias("__r"), F.col("score").alias("rs"), F.col("rank").alias("rr"))
    every = left.join(right, F.col("__l").eqNullSafe(F.col("__r")), "full_outer")
    channel = F.when(F.col("rr").isNull(), "lexical").when(F.col("lr").isNull(), "semantic").otherwise("both")
    score = F.when(channel == "both", corroborated(F.col("ls"), F.col("rs"))).otherwise(F.coalesce("ls", "rs"))
    order = [F.desc("score"), F.col("lr").asc_nulls_last(), F.col("rr").asc_nulls_last()]
    rows = every.select(F.coalesce("__l", "__r").alias(key), channel.alias("channel"), F.round(score, 6).alias("score"), "lr", "rr")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("lr", "rr")


def balance(ranked: DataFrame, source: str, cap: int, exempt: float = 1.0) -> DataFrame:
    """Re-ranks so that a source holds at most ``cap`` hits before the others' are through.

    Hits of ``exempt`` score or more always stay, and count; where there is one source only,
    nothing moves. Adds moved; the rank is the new one.
    """
    # a page's hits: the ranking is bounded by the request, so one task may order it
    mine = F.row_number().over(Window.partitionBy(source).orderBy("rank"))
    sources = F.size(F.collect_set(source).over(Window.partitionBy(F.lit(1))))
    moved = (F.col("__n") > cap) & (F.col("score") < exempt) & (F.col("__s") > 1) & F.col(source).isNotNull()
    rows = ranked.withColumns({"__n": mine, "__s": sources}).withColumn("moved", moved)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("moved", "rank"))).drop("__n", "__s")


def balance_hits(ranked: DataFrame, conversation: str, file: str, page_end: int, across: bool = True) -> DataFrame:
    """Re-ranks (score, rank) so that a conversation holds ``CONVERSATION_CAP`` hits and a file ``FILE_CAP`` before the others' are through.

    A hit has either a conversation or a file. Conversations move only if there are several and the search is ``across`` them,
    files only if there are several; a score of 1 never moves, and counts. Nothing is dropped. Adds moved and moved_down: on each source's
    first hit, how many of its hits moved from within the first ``page_end``.
    """
    talk = F.col(conversation).isNotNull()
    source = F.struct(talk.alias("talk"), F.coalesce(F.col(conversation).cast("string"), F.col(file).cast("string")).alias("name"))
    rows = ranked.withColumn("__s", source)
    whole, mine = Window.partitionBy(F.lit(1)), Window.partitionBy("__s")  # a ranking is bounded by its request
    talks, files = (F.size(F.collect_set(F.when(c, F.col("__s"))).over(whole)) for c in (talk, ~talk))
    moves = F.when(talk, F.lit(across) & (F.col("__talks") > 1)).otherwise(F.col("__files") > 1)
    cap = F.when(talk, CONVERSATION_CAP).otherwise(FILE_CAP)
    rows = rows.withColumns({"__n": F.row_number().over(mine.orderBy("rank")), "__talks": talks, "__files": files})
    rows = rows.withColumn("moved", (F.col("__n") > cap) & (F.col("score") < 1.0) & moves)
    left = F.count_if(F.col("moved") & (F.col("rank") <= page_end)).over(mine)
    rows = rows.withColumn("moved_down", F.when((F.col("__n") == 1) & (left > 0), left))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("moved", "rank"))).drop("__s", "__n", "__talks", "__files")


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """The rows ranked offset + 1 to offset + limit, each with whether there are more and where they go on."""
    rows = ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit + 1))
    last = F.max("rank").over(Window.partitionBy(F.lit(1)))
    more = F.col("__last") > offset + limit
    out = rows.withColumn("__last", last).withColumns({"truncated": more, "next_offset": F.when(more, F.lit(offset + limit))})
    return out.where(F.col("rank") <= offset + limit).drop("__last")


def composition(hits: DataFrame) -> DataFrame:
    """How many hits are code, documents and conversations."""
    corpus = F.when(F.col("kind") == "turn", "conversation").when(F.col("kind").isin("section", "row"), "doc").otherwise("code")
    return hits.groupBy(corpus.alias("corpus")).agg(F.count("*").alias("n"))


def elsewhere(ranked: DataFrame, home: str, top: int, repo: str = "identity") -> DataFrame:
    """Hits of other repositories among the first ``top``: how many and the best score."""
    others = ranked.where((F.col("rank") <= top) & (F.col(repo) != home))
    return others.groupBy(repo).agg(F.count("*").alias("hits"), F.max("score").alias("best"))

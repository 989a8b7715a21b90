"""Conversation analytics: tags, activity, messages in time, graphs and drift."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tag_pairs(tagged: DataFrame, key: str) -> DataFrame:
    """a, b and n: how many keys have both tags, a before b. Each key's sorted distinct tags meet only each other."""
    tags = tagged.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    first = tags.select("tags", F.posexplode("tags").alias("i", "a"))
    return first.select("a", F.explode(F.slice("tags", F.col("i") + 2, F.size("tags"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def top_tags(tagged: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent tags of each key, ties by name, joined in order."""
    counts = tagged.groupBy(key, "tag").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "tag"))).where(F.col("rank") <= most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ",")
    return ranked.groupBy(key).agg(listed.alias("tags"))


def jaccard(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with the share of keys that have both tags among those that have either."""
    a, b = counts.select(F.col("tag").alias("a"), F.col("n").alias("na")), counts.select(F.col("tag").alias("b"), F.col("n").alias("nb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


def distinctive(tagged: DataFrame, key: str, most: int) -> DataFrame:
    """The tags of each key with the highest frequency times ln((1 + N) / (1 + df))."""
    tf = tagged.groupBy(key, "tag").agg(F.count("*").alias("tf"))
    df = tf.groupBy("tag").agg(F.count("*").alias("df"))
    total = tagged.agg(F.count_distinct(key).alias("keys"))  # one row
    scored = tf.join(df, "tag").crossJoin(F.broadcast(total)).withColumn("weight", F.round(F.col("tf") * F.log((1 + F.col("keys")) / (1 + F.col("df"))), 6))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "tag"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "tag", "weight", "rank")


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, tolerance: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its key at or before it, within ``tolerance`` seconds.

    Both sides are laid in one order and the last right row is carried forward, so a key's rows are
    sorted once and no pairs are made. Right rows of one time count in order of their value ``tag``.
    """
    l = left.select(by, at, F.col("id").alias("id"), F.lit(None).cast("struct<at:bigint,tag:bigint>").alias("r"), F.lit(1).alias("side"))  # noqa: E741
    r = right.select(by, at, F.lit(None).cast("long").alias("id"), F.struct(F.col(at).cast("long").alias("at"), F.col("tag").cast("long").alias("tag")).alias("r"), F.lit(0).alias("side"))
    order = Window.partitionBy(by).orderBy(at, "side", "r.tag").rowsBetween(Window.unboundedPreceding, 0)
    found = l.unionByName(r).withColumn("m", F.last("r", ignorenulls=True).over(order)).where("side = 1")
    near = F.lit(True) if tolerance is None else F.col(at) - F.col("m.at") <= tolerance
    return found.select(by, at, "id", F.when(near, F.col("m.tag")).alias("tag"))


def within_interval(points: DataFrame, spans: DataFrame, by: str, at: str) -> DataFrame:
    """Points that lie in exactly one span (start, stop, span_id) of their key, with it."""
    hit = points.join(spans, by).where(F.col(at).between(F.col("start"), F.col("stop")))
    return hit.groupBy("id").agg(F.count("*").alias("n"), F.min("span_id").alias("span_id")).where("n = 1").drop("n")


def bracketed(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Fills a gap in ``value`` where the last value before and the next after it agree."""
    back = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)  # a frame that reaches to the end is read anew for each row
    before, after = F.last(value, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(ahead)
    return rows.withColumns({"__b": before, "__a": after}).withColumn("filled", F.when(F.col("__b") == F.col("__a"), F.col("__b"))).drop("__b", "__a")


def daily_spine(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def modularity(edges: DataFrame, members: DataFrame, digits: int | None = 6) -> DataFrame:
    """One row: the modularity of a partition (node, community) of undirected weighted edges (a, b, w), to so many digits."""
    a, b = members.select(F.col("node").alias("a"), F.col("community").alias("ca")), members.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    # each end of an edge counts for its community, so one pass gives degrees and what lies within
    within = F.when(F.col("ca") == F.col("cb"), F.col("w") / 2).otherwise(0.0).alias("inside")
    ends = edges.join(a, "a").join(b, "b").select(F.explode(F.array("ca", "cb")).alias("c"), "w", within)
    sums = ends.groupBy("c").agg(F.sum("w").alias("degree"), F.sum("inside").alias("inside"))
    whole = sums.agg(F.sum("inside").alias("i"), F.sum("degree").alias("d"), F.sum(F.col("degree") * F.col("degree")).alias("s"))
    q = 2 * F.col("i") / F.col("d") - F.col("s") / (F.col("d") * F.col("d"))
    return whole.select((q if digits is None else F.round(q, digits)).alias("modularity"))


def propagate_labels(edges: DataFrame, kept: Callable[[DataFrame], DataFrame], free: int = 10) -> DataFrame:
    """node and community by synchronous label propagation: each round a node takes its neighbours' heaviest label, ties the smallest, until none changes.

    A round is a join and two aggregations over the edges, whose labels ``kept`` stores. The labels
    start as the nodes. Every second round smaller labels only are taken, which keeps two-coloured
    parts from swapping, and after ``free`` rounds always, so that labels fall and the rounds end.
    """
    ways = edges.select("a", "b", "w").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    labels = kept(ways.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    i = still = 0
    while still < (2 if i < free else 1):  # of the two kinds of round neither changes any
        votes = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("a").agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("best"))
        falling = i % 2 == 1 or i >= free
        chosen = F.coalesce("best", "community")
        joined = labels.join(best, labels["node"] == best["a"], "left")
        after = kept(joined.select("node", (F.least(chosen, "community") if falling else chosen).alias("community"), F.col("community").alias("before")))
        labels = after.select("node", "community")
        still = 0 if after.where("community <> before").count() else still + 1
        i += 1
    return labels


def novelty(vectors: DataFrame, by: str, order: str, span: int, vector: str = "embedding") -> DataFrame:
    """1 minus the cosine of the mean vectors of the ``span`` rows before and from each row on; 0 without full windows."""
    flat = vectors.select(by, order, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy(by, "pos").orderBy(order)
    back, ahead = w.rowsBetween(-span, -1), w.rowsBetween(0, span - 1)
    means = flat.select(by, order, F.avg("x").over(back).alias("p"), F.avg("x").over(ahead).alias("q"), F.count("x").over(back).alias("np"), F.count("x").over(ahead).alias("nq"))
    sums = means.groupBy(by, order).agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("pq", "pp", "qq")], F.min("np").alias("np"), F.min("nq").alias("nq"))
    full = (F.col("np") == span) & (F.col("nq") == span)
    return sums.select(by, order, F.when(full, F.round(1 - F.col("pq") / F.sqrt(F.col("pp") * F.col("qq")), 6)).otherwise(0.0).alias("novelty"))


def shifts(scores: DataFrame, by: str, order: str, apart: int, most: int, percentile: float = 0.9) -> DataFrame:
    """Peaks of novelty of each key: at least the percentile of its positive scores, at least ``apart`` rows from a higher peak, ``most`` at best."""
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order).reset_index(drop=True)
        positive = rows.loc[rows["novelty"] > 0, "novelty"]
        taken: list[int] = []
        if len(positive):
            floor = positive.quantile(percentile)
            for i in rows[rows["novelty"] >= floor].sort_values(["novelty", order], ascending=[False, True]).index:
                if len(taken) < most and all(abs(i - j) >= apart for j in taken):
                    taken.append(i)
        return rows.loc[sorted(taken), [by, order, "novelty"]]

    kind = dict(scores.dtypes)
    return scores.groupBy(by).applyInPandas(pick, f"{by} {kind[by]}, {order} {kind[order]}, novelty double")

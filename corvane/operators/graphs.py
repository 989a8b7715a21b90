"""Communities by modularity: moves of single nodes in parallel, aggregation, and a warm start; principal components of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import analytics

Keep = Callable[[DataFrame], DataFrame]
#: Gain in modularity from which a fresh partition takes the place of the continued one.
LEAST_GAIN = 0.02
_TINY = 1e-12
#: The smallest part of the moves that is tried at once is one in so many.
_PARTS = 128


def _ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def gains(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, own, target and gain: the move of a single node that raises modularity most, of the nodes that have one; ties to the smaller community.

    ``edges`` (a, b, w) may hold self-loops (a = b), whose weight counts twice in a degree.
    """
    ways = _ways(edges)
    degree = ways.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    placed = members.join(degree, "node")
    total = placed.groupBy("community").agg(F.sum("k").alias("tot"))
    both = degree.agg(F.sum("k").alias("m2"))  # one row
    links = ways.where("a <> b").join(members.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"), F.col("community").alias("target")).agg(F.sum("w").alias("w"))
    # a node's tie to its own community stands beside those to others, so one pass over the ties is enough
    own = placed.join(total.withColumnRenamed("tot", "own_tot"), "community").select("node", F.col("community").alias("own"), "k", "own_tot")
    here = F.max(F.when(F.col("target") == F.col("own"), F.col("w"))).over(Window.partitionBy("node"))
    tied = links.join(own, "node").withColumn("here", F.coalesce(here, F.lit(0.0))).where("target <> own")
    moved = tied.join(total.withColumnRenamed("community", "target"), "target").crossJoin(F.broadcast(both))
    gain = 2 * ((F.col("w") - F.col("here")) - F.col("k") * (F.col("tot") - (F.col("own_tot") - F.col("k"))) / F.col("m2")) / F.col("m2")
    best = moved.withColumn("gain", gain).where(F.col("gain") > _TINY)
    return best.groupBy("node", "own").agg(F.max_by("target", F.struct("gain", -F.col("target"))).alias("target"), F.max("gain").alias("gain"))


def apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch the same community: those that are the best one of both communities they touch.

    Their gains do not depend on each other, so together they raise modularity by their sum; the best of all is among them.
    """
    rank = F.struct("gain", -F.col("node"))
    sides = moves.select("node", F.explode(F.array("own", "target")).alias("c"), rank.alias("rank"))
    first = sides.groupBy("c").agg(F.max("rank").alias("rank")).select("c", (-F.col("rank.col2")).alias("node"))
    both = first.groupBy("node").agg(F.count("*").alias("n")).where("n = 2")
    return moves.join(both.select("node"), "node", "left_semi")


def improved(edges: DataFrame, members: DataFrame, keep: Keep) -> DataFrame:
    """The partition (node, community) after moves of single nodes until none raises modularity.

    A round tries the moves of a part of the nodes at once, drawn by a hash, and smaller parts while modularity
    does not rise by them; last, only moves that do not touch each other are made. So it never falls, and the rounds end.
    """
    members = keep(members)
    quality, turn, parts = _quality(edges, members), 0, 2
    while True:
        moves = keep(gains(edges, members))
        if moves.isEmpty():
            return members
        while True:
            drawn = moves.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(parts)) == 0) if parts <= _PARTS else apart(moves)
            after = keep(_moved(members, drawn))
            risen = _quality(edges, after)
            if risen > quality + _TINY or parts > _PARTS:
                break
            parts *= 4
        if risen <= quality:  # gains below the precision of sums
            return members
        members, quality, turn, parts = after, risen, turn + 1, max(1, min(parts, _PARTS) // 2)


def _moved(members: DataFrame, moves: DataFrame) -> DataFrame:
    return members.join(moves.select("node", "target"), "node", "left").select("node", F.coalesce("target", "community").alias("community"))


def _quality(edges: DataFrame, members: DataFrame) -> float:
    return analytics.modularity(edges, members, digits=None).first()[0] or 0.0


def aggregated(edges: DataFrame, members: DataFrame) -> DataFrame:
    """The graph of communities: the weights between them summed, those within one as its self-loop."""
    sides = edges.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    return sides.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w"))


def fresh(edges: DataFrame, keep: Keep) -> DataFrame:
    """node and community from scratch: single moves, then the same over the graph of communities, until nothing moves."""
    nodes = _ways(edges).select(F.col("a").alias("node")).distinct()
    found = keep(nodes.withColumn("community", F.col("node")))
    level = edges
    while True:
        start = keep(_ways(level).select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
        members = improved(level, start, keep)
        if members.where("node <> community").isEmpty():
            return found
        found = keep(found.join(members.select(F.col("node").alias("community"), F.col("community").alias("next")), "community").select("node", F.col("next").alias("community")))
        level = keep(aggregated(level, members))


def continued(edges: DataFrame, previous: DataFrame, keep: Keep) -> DataFrame:
    """node and community from an earlier partition: new nodes join the community they are tied to most, round by round, then single moves.

    New nodes that no round reaches are communities of their own, numbered below zero. Nodes that are gone are left out.
    """
    ways = _ways(edges)
    nodes = ways.select(F.col("a").alias("node")).distinct()
    members = keep(nodes.join(previous.select("node", "community"), "node", "left"))
    while True:
        known = members.where("community IS NOT NULL").withColumnRenamed("node", "b")
        pulls = ways.join(known, "b").groupBy("a", "community").agg(F.sum("w").alias("w"))
        pulled = pulls.groupBy(F.col("a").alias("node")).agg(F.max_by("community", F.struct("w", -F.col("community"))).alias("pull"))
        after = members.where("community IS NULL").select("node").join(pulled, "node")
        if after.isEmpty():
            break
        members = keep(members.join(pulled, "node", "left").select("node", F.coalesce("community", "pull").alias("community")))
    members = members.select("node", F.coalesce("community", -1 - F.col("node")).alias("community"))
    return improved(edges, members, keep)


def chosen(edges: DataFrame, previous: DataFrame, keep: Keep, least_gain: float = LEAST_GAIN) -> tuple[DataFrame, DataFrame]:
    """The partition that stands, and one row of what it was chosen by: the continued one, unless a fresh one has ``least_gain`` more modularity."""
    warm, new = continued(edges, previous, keep), fresh(edges, keep)
    q_warm, q_fresh = _quality(edges, warm), _quality(edges, new)
    takes_fresh = q_fresh - q_warm > least_gain
    row = [("fresh" if takes_fresh else "warm", round(q_warm, 4), round(q_fresh, 4))]
    return new if takes_fresh else warm, edges.sparkSession.createDataFrame(row, "chosen string, q_warm double, q_fresh double")


def _moments(group: str, width: int):
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            groups = b.column(0).to_pylist()
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            for g in dict.fromkeys(groups):
                rows = values[[i for i, x in enumerate(groups) if x == g]]
                one = np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()])
                held[g] = held.get(g, 0) + one
        for g, sums in held.items():
            yield pa.record_batch([pa.array([g] * len(sums), b.schema.field(0).type), pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=[group, "pos", "x"])

    return run


def components(rows: DataFrame, group: str, width: int, n: int = 2, vector_col: str = "embedding") -> DataFrame:
    """group, size, mean and axes: the first ``n`` principal components of each group's vectors, the largest loading of each positive.

    A task sums the outer products of what it reads, so a group of any size comes to one task as width x width numbers.
    """
    kind = dict(rows.dtypes)[group]
    sums = rows.select(group, vector_col).mapInArrow(_moments(group, width), f"`{group}` {kind}, pos int, x double").groupBy(group, "pos").agg(F.sum("x").alias("x"))

    def solve(cells):
        import numpy as np
        import pandas as pd

        x = cells.sort_values("pos")["x"].to_numpy()
        size, total, outer = x[0], x[1 : width + 1], x[width + 1 :].reshape(width, width)
        mean = total / size
        values, vectors = np.linalg.eigh(outer / size - np.outer(mean, mean))
        axes = vectors[:, np.argsort(-values, kind="stable")[:n]].T
        axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
        return pd.DataFrame({group: [cells[group].iloc[0]], "size": [int(size)], "mean": [mean.tolist()], "axes": [axes.tolist()]})

    return sums.groupBy(group).applyInPandas(solve, f"`{group}` {kind}, size long, mean array<double>, axes array<array<double>>")


def layout(rows: DataFrame, group: str, width: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, group, x and y of each vector in its group's first two components; zeros in groups of less than three."""
    found = components(rows, group, width, 2, vector_col)
    less = F.zip_with(vector_col, "mean", lambda v, m: v.cast("double") - m)
    on = lambda i: F.aggregate(F.zip_with("less", F.col("axes")[i], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    placed = rows.select(id_col, group, vector_col).join(found, group).withColumn("less", less)
    return placed.select(id_col, group, *[F.when(F.col("size") >= 3, on(i)).otherwise(0.0).alias(name) for i, name in enumerate("xy")])

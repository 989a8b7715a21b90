"""Communities and components against numpy and by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics, graphs
from corvane.scratch import kept


def quality(edges, label):
    m = sum(w for _, _, w in edges)
    inside, degree = {}, {}
    for a, b, w in edges:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items())


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(8)
    edges = {}
    for i in range(60):
        for j in range(i + 1, 60):
            if draw.random() < (0.6 if i // 20 == j // 20 else 0.05):
                edges[i, j] = round(draw.random() + 0.5, 3)
    rows = [(a, b, w) for (a, b), w in edges.items()] + [(3, 3, 1.5)]
    return rows, kept(spark.createDataFrame(rows, "a long, b long, w double"))


def settled(rows, label):
    """Whether no move of one node raises modularity."""
    base = quality(rows, label)
    return all(quality(rows, {**label, x: c}) <= base + 1e-9 for x in label for c in set(label.values()))


def test_gains_are_those_of_modularity(spark, planted):
    rows, edges = planted
    label = {i: i % 4 for i in range(60)}
    members = spark.createDataFrame(list(label.items()), "node long, community long")
    got = {r.node: r for r in graphs.gains(edges, members).collect()}
    base = quality(rows, label)
    for x in label:
        others = {c: quality(rows, {**label, x: c}) - base for c in range(4) if c != label[x]}
        best = max(others.values())
        if best > 1e-9:
            assert abs(got[x].gain - best) < 1e-9 and abs(others[got[x].target] - best) < 1e-9
        else:
            assert x not in got
    assert abs(analytics.modularity(edges, members, None).first()[0] - base) < 1e-9


def test_moves_never_lower_modularity(spark, planted, monkeypatch):
    rows, edges = planted
    seen = []
    monkeypatch.setattr(graphs, "_quality", lambda e, m, real=graphs._quality: seen.append(real(e, m)) or seen[-1])
    start = spark.createDataFrame([(i, i % 5) for i in range(60)], "node long, community long")
    label = {r.node: r.community for r in graphs.improved(edges, start, kept).collect()}
    assert settled(rows, label) and quality(rows, label) >= seen[0]


def test_fresh_and_continued(spark, planted):
    rows, edges = planted
    found = graphs.fresh(edges, kept)
    label = {r.node: r.community for r in found.collect()}
    groups = {frozenset(x for x in label if label[x] == c) for c in set(label.values())}
    assert groups == {frozenset(range(k, k + 20)) for k in (0, 20, 40)}
    # an earlier partition that lacks nodes, and names one that is gone
    previous = spark.createDataFrame([(i, 100 + i // 20) for i in range(60) if i % 3] + [(999, 100)], "node long, community long")
    warm = {r.node: r.community for r in graphs.continued(edges, previous, kept).collect()}
    assert warm == {i: 100 + i // 20 for i in range(60)}
    row = graphs.chosen(edges, previous, kept)[1].first()
    assert row.chosen == "warm" and abs(row.q_warm - row.q_fresh) < 1e-4
    poor = spark.createDataFrame([(i, 7) for i in range(60)], "node long, community long")
    assert graphs.chosen(edges, poor, kept)[1].first().chosen == "fresh"
    alone = edges.unionAll(spark.createDataFrame([(500, 501, 1.0)], "a long, b long, w double"))
    labels = {r.node: r.community for r in graphs.continued(alone, previous, kept).collect()}
    assert labels[500] == labels[501] < 0


def test_components_are_those_of_numpy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") < 2, 99).otherwise(F.col("label")))
    got = {r.vec_id: (r.x, r.y) for r in graphs.layout(rows.repartition(5), "label", 64).collect()}
    held = {}
    for r in rows.orderBy("vec_id").collect():
        held.setdefault(r.label, []).append((r.vec_id, r.embedding))
    for members in held.values():
        x = np.array([v for _, v in members], float)
        want = np.zeros((len(x), 2))
        if len(x) >= 3:
            x = x - x.mean(axis=0)
            axes = np.linalg.svd(x, full_matrices=False)[2][:2]
            axes *= np.sign(axes[[0, 1], np.abs(axes).argmax(axis=1)])[:, None]
            want = x @ axes.T
        assert np.allclose([got[i] for i, _ in members], want, atol=1e-6)

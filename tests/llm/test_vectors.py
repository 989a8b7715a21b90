"""Vector codes, clusters and toxicity against brute force, and on awkward rows."""

import itertools

import duckdb
import numpy as np
import pytest

from corvane.llm import clusters, codes, toxicity
from corvane.llm import queries as llm
from corvane.llm.storage import stored

FOLDER = "/root/testdata/sf0.001"


def nearest_by_hand(points, entries):
    gaps = np.square(points[:, None, :] - entries[None, :, :]).sum(axis=2)
    return gaps.argmin(axis=1), gaps.min(axis=1)  # argmin takes the first of equal ones


@pytest.mark.parametrize("search", [codes.nearest, clusters.nearest])
@pytest.mark.parametrize("spread", [2, 40, 1 << 22])
def test_searches_are_exact(search, spread):
    draw = np.random.default_rng(spread)
    for width, k in ((1, 1), (4, 64), (64, 40), (3, 7)):
        entries = draw.integers(-spread, spread + 1, (k, width))
        entries[k // 2 :] = entries[: k - k // 2]  # repeated entries: ties
        points = np.concatenate([draw.integers(-spread, spread + 1, (500, width)), entries])
        for got, want in zip(search(points, entries), nearest_by_hand(points, entries), strict=True):
            assert (got == want).all()
    none = np.zeros((0, 4), np.int64)
    assert len(search(none, np.zeros((2, 4), np.int64))[0]) == 0


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_clusters"])
def test_equal_to_sql(spark, name):
    rows = llm.QUERIES[name](spark, FOLDER)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
        sql = con.execute(llm.ORACLE_SQL[name])
        names = [d[0] for d in sql.description]
        assert sorted(map(tuple, rows.select(*names).collect())) == sorted(sql.fetchall())


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' AS code", "1 AS error", "2 AS cluster", "3 AS distance", "'y' AS slot", "0 AS salt")


def vector(*head):
    return [*map(float, head), *[0.0] * (64 - len(head))]


#: Null and undefined components, a null and a repeated row, no identifier, no label, other widths.
AWKWARD = [
    (1, vector(1), 7),
    (2, vector(-0.001), None),
    (3, None, 7),
    (4, [*vector()[:-1], None], 7),
    (5, vector(float("inf")), 7),
    (6, vector(float("nan")), 7),
    (7, vector(1.5), None),
    (7, vector(1.5), None),
    (None, vector(2), 7),
    (8, [1.0] * 32, 7),
    (9, [], 7),
]


def test_codes_of_awkward_rows(spark):
    got = {}
    for r in codes.code_report(vectors_of(spark, AWKWARD)).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == {1, 2, 7, None, 8, 9} and len(got[7]) == 2
    assert got[8][0]["code"] is None and got[8][0]["error"] is None and got[9][0]["code"] is None
    # entries start at vec_id 1, 2, 7, 7: entry 2 takes 384, 384 and 512 and becomes 426, entry 3 stays 384 and takes its two back; then entry 2 is 512
    assert got[7][0]["code"] == got[7][1]["code"] == "03" + "00" * 15 and got[None][0]["code"] == "02" + "00" * 15
    assert got[None][0]["error"] == got[7][0]["error"] == 0
    assert got[7][0]["label_error"] == got[2][0]["error"]
    assert got[8][0]["label_error"] == got[1][0]["error"] + got[None][0]["error"]


def test_clusters_of_awkward_rows(spark):
    got = {}
    for r in clusters.clustered(vectors_of(spark, AWKWARD)).collect():
        got.setdefault(r["vec_id"], []).append(r)
    assert set(got) == {1, 2, 7, None} and len(got[7]) == 2
    assert got[7][0]["cluster"] == got[7][1]["cluster"] != got[None][0]["cluster"]
    total = sum(r["distance"] for rows in got.values() for r in rows)
    assert {r["inertia"] for rows in got.values() for r in rows} == {total}


def test_no_vectors(spark):
    for rows in ([], [(1, None, 3)]):
        assert codes.code_report(vectors_of(spark, rows)).count() == 0
        assert clusters.clustered(vectors_of(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        codes.code_report(vectors_of(spark, [(1, [1.0] * 10, 3)]))


def test_marginals_by_enumeration():
    draw = np.random.default_rng(5)
    model = toxicity.Model({}, draw.normal(size=(6, 2)), draw.normal(size=(2, 2)), draw.normal(size=2), np.zeros(4), 0.0)
    marks = np.array([1, 0, 5, -1, -1, 2, 2, 0, 4, 3, -1, 0, -1])
    seq = toxicity.sequences(marks)
    toxic, scale, pairs = toxicity.marginals(seq, model)
    got = np.zeros(len(toxic))
    got[seq.words] = toxic
    want, both = [], np.zeros((2, 2))
    for s in ([1, 0, 5], [2, 2, 0, 4, 3], [0]):
        weights = {}
        for y in itertools.product((0, 1), repeat=len(s)):
            w = model.start[y[0]] + sum(model.emission[x, z] for x, z in zip(s, y, strict=True)) + sum(model.transition[a, b] for a, b in itertools.pairwise(y))
            weights[y] = np.exp(w)
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(len(s))]
        for y, w in weights.items():
            for a, b in itertools.pairwise(y):
                both[a, b] += w / z
    assert np.allclose(got, want) and np.allclose(pairs.sum(axis=0), both)


def test_long_sentences_go_on():
    seq = toxicity.sequences(np.array([*range(6)] * 50 + [-1]))
    assert len(seq.symbols) == 300 and seq.sizes == [3] * (300 - 2 * toxicity.SEQUENCE) + [2] * (3 * toxicity.SEQUENCE - 300)
    assert sorted(seq.words.tolist()) == list(range(300))


def test_toxicity_on_unseen_documents(spark):
    sf = "/root/testdata/sf0.1"
    found = llm.QUERIES["op13_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    caught = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    assert right >= 0.97 and caught >= 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


@pytest.fixture(scope="module")
def small_model(spark):
    rude = [(i, f"Plain words here. You are a total muppet, {w} indeed.", 1) for i, w in enumerate(["one", "two", "three", "four"] * 10)]
    mild = [(100 + i, f"Plain words here. You are a total star, {w} indeed.", 0) for i, w in enumerate(["one", "two", "three", "four"] * 20)]
    docs = spark.createDataFrame([r[:2] for r in rude + mild], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rude + mild], "doc_id long, toxic int")
    return toxicity.train(docs, labels, stored)


def test_spans(spark, small_model):
    texts = ["İi say: what a MUPPET! A fine day", "A fine day", None, "", "123 %%", "muppet " * 30000]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, spans string, score double")
    got = {r["doc_id"]: r for r in toxicity.score(docs, small_model).collect()}
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(15, 21)]
    assert got[0]["score"] > 0.3 > got[1]["score"] and not got[1]["spans"]
    assert [got[i]["score"] for i in (2, 3, 4)] == [small_model.prior] * 3
    assert [(s["start"], s["end"]) for s in got[5]["spans"]] == [(0, 209999)]


def test_awkward_labels(spark, small_model):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (1, 0), (None, 1), (2, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(docs, labels, stored).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert toxicity.toxicity_report(docs.limit(0), labels, stored).count() == 0
    assert toxicity.toxicity_report(docs, labels.limit(0), stored).count() == 4


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_report(docs, x, stored).collect())) for x in (labels, turned))
    assert a == b

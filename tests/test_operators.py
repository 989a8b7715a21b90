"""Hand-checked cases and invariants of the operators."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text
from corvane import scratch
from corvane.operators import analytics, conversations, hybrid, lexical, maintenance, provenance, queue, vector


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def element(i, name, body, kind="file", turn_class=None):
    return (i, kind, name, f"el:{i}", body, turn_class)


ELEMENT = "id long, kind string, name string, address string, raw_text string, turn_class string"


def test_lexical_tiers(spark):
    rows = [
        element(1, "scope cache", "nothing here"),
        element(2, "a", "the scope cache is here"),
        element(3, "b", "cache, then a scope"),
        element(4, "c", "only a scope"),
        element(5, "t1", "the scope cache is here", "turn", "work"),
        element(6, "t2", "scope cache", "turn", "retrieval_call"),
    ]
    df = spark.createDataFrame(rows, ELEMENT)
    got = {r.id: r.score for r in lexical.lexical_search(df, "scope cache").collect()}
    assert set(got) == {1, 2, 3, 5}
    assert got[1] == got[2] == 1.0 and 0.65 < got[3] <= 0.69 and 0.80 < got[5] <= 0.84
    assert lexical.hidden_count(df, "scope cache").first().hidden == 1
    assert lexical.lexical_search(df, "ab").count() == 0


def test_question_words_are_not_required(spark):
    df = spark.createDataFrame([element(1, "x", "a worktree"), element(2, "y", "how a worktree is made")], ELEMENT)
    got = {r.id: r.score for r in lexical.lexical_search(df, "how worktree").collect()}
    assert got[1] < 0.65 < got[2]


def test_request_limits():
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"source": "other"}, {"min_score": 2.0}):
        with pytest.raises(ValueError):
            lexical.SearchFilters(**bad)


def test_vector_order_tie_and_floor(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = vector.nearest(df, [1.0, 0.0], 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4]
    assert vector.nearest(df, [1.0, 0.0], 4, min_score=0.5).count() == 3
    asked = df.where("vec_id = 2")
    for share, most in ((1.0, 4), (0.5, 2)):
        rows = vector.search(df, asked, 4, share=share).orderBy("rank").collect()
        assert [(r.asked, r.id) for r in rows] == [(2, i) for i in (1, 2, 3, 4)[:most]]
    assert [r.id for r in vector.search(df, asked, 4, min_score=0.5, itself=False).orderBy("rank").collect()] == [1, 3]
    assert vector.search(df.limit(0), asked, 4).count() == vector.search(df, df.limit(0), 4).count() == 0


def test_vector_search_in_several_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 2, float(i % 3) - 1.5]) for i in range(60)], "vec_id long, embedding array<float>")
    whole = sorted(tuple(r) for r in vector.search(df, df, 5).collect())
    monkeypatch.setattr(vector, "BLOCK_ROWS", 13)
    assert sorted(tuple(r) for r in vector.search(df, df, 5).collect()) == whole


def test_shortlist_recall(spark):
    """Over every query of every size at hand, nine in ten of the nearest are in the shortlist."""
    for folder in ("sf0.001", "sf0.01", "sf0.1"):
        v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
        asked = v.where("vec_id % 100 = 0")
        found = vector.recall(vector.search(v, asked, 20), vector.search(v, asked, 20, share=vector.SHORTLIST))
        assert found.agg({"recall": "avg"}).first()[0] >= 0.9


LEGS = st.lists(st.tuples(st.integers(0, 12), st.floats(0, 1).map(lambda x: round(x, 3))), max_size=8, unique_by=lambda x: x[0])


@settings(max_examples=8, deadline=None)
@given(LEGS, LEGS)
def test_fusion_and_balance(spark, left, right):
    def leg(rows):
        ranked = sorted(rows, key=lambda x: -x[1])
        return spark.createDataFrame([(i, s, n + 1) for n, (i, s) in enumerate(ranked)], "id long, score double, rank int")

    fused = hybrid.fuse(leg(left), leg(right)).withColumn("source", F.col("id") % 3)
    got = {r.id: r.score for r in fused.collect()}
    assert set(got) == {i for i, _ in left} | {i for i, _ in right}
    assert all(0 <= s <= 1 for s in got.values()) and all(got[i] >= s - 1e-6 for i, s in left)
    balanced = hybrid.balance(fused, "source", 1).collect()
    assert sorted(r.id for r in balanced) == sorted(got)
    assert sorted(r["rank"] for r in balanced) == list(range(1, len(got) + 1))


@settings(max_examples=30, deadline=None)
@given(st.text("ab*?%_/.", max_size=8), st.text("ab%_/.", max_size=8))
def test_glob_means_what_like_means(glob, path):
    like = provenance.glob_to_like(glob)
    pattern = "".join({"%": ".*", "_": "."}.get(p, re.escape(p[-1])) for p in re.findall(r"\\.|.", like))
    open_glob = glob if glob.endswith("*") else glob + "*"
    wanted = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in open_glob)
    assert bool(re.fullmatch(pattern, path)) == bool(re.fullmatch(wanted, path))


def test_representative_and_roots(spark):
    df = spark.createDataFrame([("b", "r", "x", "h"), ("a", None, "y", "h"), ("a", "r", "z", "h")], "identity string, root_path string, path string, blob_sha string")
    assert provenance.representative(df).first().path == "z"
    paths = spark.createDataFrame([("a/b/c",), ("ab/c",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root_path string")
    assert values(provenance.longest_root(paths, roots), "path") == [("a/b/c",), ("ab/c",)]
    assert provenance.longest_root(paths, roots).where("path = 'a/b/c'").first().root_path == "a/b"
    assert provenance.longest_root(paths, roots).where("path = 'ab/c'").first().root_path is None


def test_append_is_idempotent(spark):
    records = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5)], "conv_id long, ordinal long")
    none = spark.createDataFrame([], "conv_id long, ordinal long")
    turns = spark.createDataFrame([(1, 7)], "conv_id long, turn_no long")
    first = conversations.append(none, records, ["conv_id"], turns)
    assert values(first, "conv_id", "ordinal", "turn_no") == [(1, 1, 8), (1, 2, 9), (2, 5, 1)]
    assert conversations.append(first, records, ["conv_id"], turns).count() == 0


def test_classifier_carries_over_results(spark):
    # call of retrieval, result, prose, result, other call, result
    flags = [(True, True, False), (False, False, False), (False, False, True), (False, False, False), (True, False, False), (False, False, False)]
    df = spark.createDataFrame([(1, i, *f) for i, f in enumerate(flags)], "conv_id long, turn_no long, calls boolean, retrieval boolean, breaks boolean")
    got = conversations.classify(df, F.col("calls"), F.col("retrieval"), F.col("breaks")).orderBy("turn_no").collect()
    assert [r.turn_class for r in got] == ["retrieval_call", "retrieval_result", "work", "tool_result", "tool_call", "tool_result"]


def test_garbage_frees_nothing_twice(spark):
    e = spark.createDataFrame([("b1", "h1"), ("b2", "h2")], "blob_sha string, raw_hash string")
    s = spark.createDataFrame([("h1", "s1"), ("h2", "s2")], "raw_hash string, text_hash string")
    v = spark.createDataFrame([("h1",), ("s2",), ("s1",)], "source_hash string")
    j = spark.createDataFrame([("h2",)], "raw_hash string")
    live = spark.createDataFrame([("b1",)], "blob_sha string")
    got = {r.level: (r.kept, r.freed) for r in maintenance.collect_garbage(j, e, s, v, live).collect()}
    assert got == {"jobs": (0, 1), "elements": (1, 1), "summaries": (1, 1), "vectors": (2, 1)}


def test_upsert_keeps_the_newest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "k long, v string, n long")
    assert values(maintenance.upsert(old, new, ["k"], "n"), "k", "v") == [(1, "a"), (2, "c"), (3, "e")]


def test_bursts(spark):
    df = spark.createDataFrame([(1, 1, t) for t in (0, 5, 9, 30, 35, 40, 45, 50, 55)], "user long, event_id long, at long")
    assert values(queue.debounce(df, "user", "at", 10), "first", "last", "n", "settled") == [(0, 9, 3, 19), (30, 55, 6, 65)]
    assert values(queue.debounce_bounded(df, "user", "at", 10, 15), "first", "last", "n", "settled", "reason") == [
        (0, 9, 3, 15, "age"), (30, 40, 3, 45, "age"), (45, 55, 3, 60, "age"),
    ]


def test_asof_and_intervals(spark):
    left = spark.createDataFrame([(1, 10, 100), (1, 50, 101), (2, 10, 102)], "k long, at long, id long")
    right = spark.createDataFrame([(1, 5, 7), (1, 10, 8), (1, 60, 9)], "k long, at long, tag long")
    assert values(analytics.asof_backward(left, right, "k", "at", 20).fillna(-1), "id", "tag") == [(100, 8), (101, -1), (102, -1)]
    spans = spark.createDataFrame([(1, 0, 20, 1), (1, 15, 60, 2)], "k long, start long, stop long, span_id long")
    assert values(analytics.within_interval(left, spans, "k", "at"), "id", "span_id") == [(100, 1), (101, 2)]


def test_text_functions(spark):
    def one(column, *rows):
        return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "s string").select(column(F.col("s"))).collect()]

    urls = ["https://GitHub.com/a/b.git", "git@github.com:a/b.git", "ssh://git@github.com:22/a/b/", "https://u:p@github.com/a/b"]
    assert set(one(text.repository_key, *urls)) == {"github.com/a/b"}
    assert one(text.canonical_tag, "Unit-Tests", "Parsers #12", "bus", "src/Files.py", "!!") == ["unit test", "parser", "bus", "src/files.py", None]
    assert one(text.identifier_words, "parseHTTPReply2x") == [["parse", "http", "reply", "2", "x"]]
    assert one(text.canonical_model, "openai/GPT-5-20250101", "m[1x]") == ["gpt-5", "m"]
    assert one(text.minted_prefix, "plan-0a1b", "a-b-0a1b", "plan-0a1") == ["plan", None, None]
    assert one(lambda c: text.chunks(c, 4, 1), "abcdefgh", "") == [["abcd", "defg", "gh"], [""]]
    head = one(lambda c: text.head(c, 4), "abé", "abcé")
    assert (head[0]["head"], head[0]["truncated"]) == ("abé", False) and (head[1]["head"], head[1]["truncated"]) == ("abc", True)


def test_labels_follow_the_heavier_side(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.1)], "a long, b long, w double")
    got = dict((r.node, r.community) for r in analytics.propagate_labels(edges, scratch.kept).collect())
    assert len({got[1], got[2], got[3]}) == 1 and len({got[4], got[5], got[6]}) == 1
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "a long, b long, w double")
    settled = {r.node: r.community for r in analytics.propagate_labels(chain, scratch.kept).collect()}
    assert len(settled) == 31  # it ends, though labels travel one edge a round


def test_single_precision_leaves_few_scores_and_loses_none_of_the_best():
    r = np.random.default_rng(2)
    for n, k, copies in ((20000, 10, 0), (9000, 40, 60), (2100, 3, 60), (300, 10, 0)):
        held = r.standard_normal((n, 64))
        held[n // 3 : n // 3 + copies] = held[5]
        held /= np.linalg.norm(held, axis=1)[:, None]
        scores, rough = held[:70] @ held.T, held[:70].astype(np.float32) @ held.astype(np.float32).T
        for x in (scores, rough):
            x[3], x[:, 17] = -np.inf, -np.inf
        x, y = vector._likely(rough, k, 2 * 68 * 2.0**-24 + 2e-6)
        got, want = vector._ranked(x, y, np.einsum("ij,ij->i", held[x], held[y]), k), vector._best(scores, k)
        assert all(np.array_equal(i, j) for i, j in zip(got, want, strict=True))
        assert n < 2048 or len(x) < 70 * (k + 20)

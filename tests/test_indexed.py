"""Stored indexes: the same pages as scoring everything, with less read."""

import math
import random
import re
from collections import Counter

import pytest

from corvane import scratch
from corvane.operators import bm25, signs, vector


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the", "then", "of"]
    weights = [1] * 60 + [40, 5, 30]
    rows = [(i, f"name {draw.choice(words)}", " ".join(draw.choices(words, weights, k=draw.randint(0, 60)))) for i in range(3000)]
    rows += [(5000, None, None), (5001, "", "The of THE of the")]
    folder = scratch.folder(spark)
    bm25.build(spark.createDataFrame(rows, "id long, name string, raw_text string"), folder)
    return rows, bm25.open_index(spark, folder)


def best_by_hand(rows, words, k, field, phrase):
    said = {r[0]: re.findall("[a-z0-9_]+", (r[2] if field == "body" else r[1] or "").lower() if r[2] is not None or field == "name" else "") for r in rows}
    average = sum(map(len, said.values())) / len(said)
    df = Counter(t for ts in said.values() for t in set(ts))
    found = []
    for i, ts in said.items():
        count, score = Counter(ts), 0
        for w in words:
            hits = [t for t in count if (t == w if phrase else t.startswith(w))]
            if not hits:
                break
            weigh = lambda t: math.log(1 + (len(said) - df[t] + 0.5) / (df[t] + 0.5)) * count[t] * 2.2 / (count[t] + 1.2 * (0.25 + 0.75 * len(ts) / average))  # noqa: B023, E731
            score += max(round(weigh(t) * 1e6) for t in hits)
        else:
            if not phrase or any(ts[j : j + len(words)] == words for j in range(len(ts))):
                found.append((i, score))
    return sorted(found, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize(
    ("words", "k", "field", "phrase"),
    [
        (["the", "of"], 10, "body", False),
        (["the"], 3, "body", False),
        (["the", "of", "w1"], 500, "body", False),
        (["the", "w7"], 10_000, "body", False),
        (["w3"], 20, "name", False),
        (["the", "of"], 10, "body", True),
        (["the", "the"], 10, "body", True),
        (["the", "of", "the", "of", "the"], 5, "body", True),
        (["nowhere", "the"], 5, "body", False),
    ],
)
def test_windows_are_the_best(corpus, words, k, field, phrase):
    rows, index = corpus
    got = [tuple(r) for r in bm25.window(index, words, k, field, phrase).collect()]
    want = best_by_hand(rows, words, k, field, phrase)
    assert sorted(got) == sorted(want)


def test_build_joins_frequent_tokens_and_others(spark, corpus, monkeypatch):
    """Postings of frequent tokens are not dealt by their token; the index is the same wherever the line is drawn."""
    rows, index = corpus
    elements = spark.createDataFrame(rows, "id long, name string, raw_text string")
    want = sorted(map(str, index.postings.collect())), sorted(map(str, index.terms.collect()))
    for frequent in (1, 60):  # no token, and some
        monkeypatch.setattr(bm25, "FREQUENT", frequent)
        folder = scratch.folder(spark)
        bm25.build(elements, folder)
        made = bm25.open_index(spark, folder)
        assert (sorted(map(str, made.postings.collect())), sorted(map(str, made.terms.collect()))) == want
    monkeypatch.undo()
    assert {r.token: r.places for r in index.postings.where("id = 5001").collect()} == {"the": [0, 2, 4], "of": [1, 3]}


def test_tails_stay_unread(corpus):
    _, index = corpus
    least = bm25.bounds(index, ["the", "of"], 10)
    lists = index.postings.where("field = 'body' AND (token LIKE 'the%' OR token LIKE 'of%')")
    read = lists.where(f"(token LIKE 'the%' AND weight >= {least['the']}) OR (token LIKE 'of%' AND weight >= {least['of']})")
    assert read.count() < 0.6 * lists.count()  # short lists with weights close together; longer ones leave out more
    plan = bm25.window(index, ["the", "of"], 10)._jdf.queryExecution().toString()
    assert "StringStartsWith(token,the),GreaterThanOrEqual(w" in plan[plan.rfind("PushedFilters") :] and "places" not in plan[plan.rfind("ReadSchema") :]


def test_signs_kept_beside_their_vectors(spark):
    draw = random.Random(4)
    made = [(i, [draw.gauss(0, 1) for _ in range(70)], i % 2) for i in range(400)]
    vectors = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")
    folder = scratch.folder(spark)
    assert signs.opened(spark, folder) is None
    assert signs.build(vectors, folder, "one", 70, "v1") == 400
    changed = [(i, [-x for x in v] if i == 5 else v, g) for i, v, g in made if i != 7] + [(900, made[0][1], 1)]
    later = spark.createDataFrame(changed, "vec_id long, embedding array<float>, label int")
    counts = signs.coverage(later, signs.opened(spark, folder), "v1", "label")
    assert {r.label: (r.vectors, r.missing, r.drifted) for r in counts.collect()} == {0: (200, 0, 0), 1: (200, 1, 1)}
    assert signs.state(counts) == "drifted"
    assert signs.build(later, folder, "two", 70, "v1") == 2  # the gap and the drift, no more
    copy = signs.opened(spark, folder)
    assert copy.count() == 400 and signs.state(signs.coverage(later, copy, "v1", "label")) == "ready"
    words = {r.id: r.words for r in copy.collect()}
    for i, v, _ in changed:
        bits = [(words[i][j // 64] >> (j % 64)) & 1 for j in range(70)]
        assert bits == [int(x > 0) for x in v]
    asked = later.where("vec_id % 20 = 0")
    found = signs.search(copy, later, asked, 10)
    recall = vector.recall(vector.search(later, asked, 10), found).agg({"recall": "avg"}).first()[0]
    assert recall >= 0.9
    assert signs.search(copy.limit(0), later, asked, 10).count() == 0


def test_shortlists_do_not_depend_on_blocks(spark, monkeypatch):
    """The share and the number are of all rows, also where the rows are dealt into blocks; equal keys go by id."""
    draw = random.Random(8)
    made = [(i, [float(draw.randint(-2, 2)) + 0.5 for _ in range(6)]) for i in range(900)]
    vectors = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 30 = 0")
    copy = signs.copies(vectors, 6, "v1")

    def by_hand(k, many, key):
        out = []
        for i, q in made[::30]:
            short = sorted(made, key=lambda r: (key(q, r[1]), r[0]))[:many]
            cosine = lambda v: round(min(1.0, sum(map(float.__mul__, q, v)) / math.sqrt(sum(x * x for x in q) * sum(x * x for x in v))), 6)  # noqa: B023, E731
            best = sorted(((-cosine(v), j) for j, v in short))[:k]
            out += [(i, j, -c, n + 1) for n, (c, j) in enumerate(best)]
        return sorted(out)

    rows = lambda df: sorted((r.asked, r.id, r.score, r.rank) for r in df.collect())
    weighed = by_hand(4, 4 * signs.WANTED + 90, lambda q, v: -sum(x if y > 0 else -x for x, y in zip(q, v, strict=True)))
    unlike = by_hand(40, 450, lambda q, v: sum((x > 0) != (y > 0) for x, y in zip(q, v, strict=True)))
    for size in (10_000, 100):
        monkeypatch.setattr(vector, "BLOCK_ROWS", size)
        assert rows(signs.search(copy, vectors, asked, 4)) == weighed
        assert rows(vector.search(vectors, asked, 40, share=0.5)) == unlike

"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import shingles

FOLDER = "/root/testdata/sf0.001"


def sets_by_hand(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_hand(docs, similarity=0.8):
    sets = {i: sets_by_hand(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = set()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                pairs.add((a, b))
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i for i in sets if root(i) == i}, pairs


def chains(n=60):
    """Drifting copies of one text: neighbours are similar, the ends are not; and texts of one to nine words."""
    base = [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        base[(i * 37) % 200] = f"x{i}"
        out.append((i, " ".join(base)))
    out += [(100 + i, " ".join(f"s{j}" for j in range(1 + i % 9))) for i in range(27)]
    return out


def test_links_drifting_copies_and_short_texts(spark):
    docs = chains()
    kept, pairs = kept_by_hand(docs)
    assert pairs
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs] + [(None, docs[0][1], "clash")], "doc_id long, text string, node string")
    found = shingles.shingle_dedup(df)
    assert found.columns == df.columns
    assert {r.doc_id for r in found.collect()} == kept | {None}
    assert shingles.shingle_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.7, 0.8, 0.95])
@pytest.mark.parametrize("size", [6, 40, 90, 130, 700])
def test_similar_sets_share_a_block(similarity, size):
    """Of pairs just at the threshold, all but one in a hundred at most; what is ruled out before texts are read never is similar."""
    draw = np.random.default_rng(size)
    shared = 0
    for _ in range(300):
        apart = int(size * (1 - similarity) / (1 + similarity) + 1e-9)  # of each set's own
        whole = draw.integers(0, 1 << 63, size + apart, dtype=np.uint64)
        a, b = np.unique(whole[:size]), np.unique(whole[apart:])
        assert shingles.similar(a, b, similarity)
        assert shingles.possible(len(a), shingles.sketch(a), len(b), shingles.sketch(b), similarity)
        bits = np.bitwise_count((shingles.summary(a) ^ shingles.summary(b)).view("<u8"))
        assert bits[shingles.SIM_WORDS :].sum() <= 2 * apart
        assert size < shingles.LARGE or bits[: shingles.SIM_WORDS].sum() <= shingles.most_bits(similarity)
        shared += bool(set(shingles.keys(a, similarity).tolist()) & set(shingles.keys(b, similarity).tolist()))
    assert shared >= 297


def test_crowded_blocks_of_unlike_documents_and_of_copies(spark, monkeypatch):
    """Many documents around one passage are not alike; many copies of one text, alike to it but not to each other, are one group."""
    monkeypatch.setattr(shingles, "MANY", 8)
    draw = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    unlike = [(n, passage + " " + " ".join(f"u{n}x{i}" for i in range(60))) for n in range(150)]
    words = [f"b{i}" for i in range(150)]
    copies = [(1000, " ".join(words))]
    for n in range(150):
        own = list(words)
        for at in draw.choice(np.arange(0, 150, 5), 3, replace=False):
            own[at] = f"c{n}x{at}"
        copies.append((1001 + n, " ".join(own)))
    docs = unlike + copies
    kept, pairs = kept_by_hand(docs)
    got = {r.doc_id for r in shingles.shingle_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == kept and len(kept) == 151


def test_stage_drops_what_brute_force_finds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, pairs = kept_by_hand(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    assert pairs
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, FOLDER).collect()} == kept


def test_summaries_count_bits_of_long_sets():
    found = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 40_000).astype("<u8"))
    salts = np.arange(1, shingles.SIM_WORDS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for part in (found, found[:1], found[:255], found[:256], found[:0]):
        bits = np.unpackbits(shingles._mixed(part[:, None] ^ salts[None, :]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) if len(part) else np.zeros(64 * shingles.SIM_WORDS, np.int64)
        want = np.packbits(2 * bits > len(part), bitorder="little").view("<i8")
        assert (shingles.summary(part)[: shingles.SIM_WORDS] == want).all()


def test_crowded_blocks_leave_no_pair_out(spark, monkeypatch):
    """Pairs that share one crowded block only, and are not connected through its centre or a drawn document, are linked as well."""
    monkeypatch.setattr(shingles, "MANY", 8)
    monkeypatch.setattr(shingles, "PART", 13)
    profiled = shingles._profiles
    monkeypatch.setattr(shingles, "_profiles", lambda *x: profiled(*x).withColumn("keys", F.array(F.lit(7).cast("long"))))  # one block that all share
    docs = [(n, " ".join(f"{n // 2}v{i}" for i in range(60)) + f" end{n}") for n in range(80)]
    found = {(r.a, r.b) for r in shingles.links(spark.createDataFrame(docs, "node long, text string")).collect()}
    assert found == {(n, n + 1) for n in range(0, 80, 2)}


def test_crowded_blocks_give_back_no_more_rows_than_documents(spark, monkeypatch):
    """What is a little less than similar, and what is similar to all others, leaves a task's comparison in a number of rows below that of documents."""
    monkeypatch.setattr(shingles, "MANY", 8)
    monkeypatch.setattr(shingles, "TURNS", 0)
    profiled, kept, sizes = shingles._profiles, shingles.stored, []
    monkeypatch.setattr(shingles, "_profiles", lambda *x: profiled(*x).withColumn("keys", F.array(F.lit(7).cast("long"))))
    monkeypatch.setattr(shingles, "stored", lambda df, *x: (made := kept(df, *x), sizes.append(made.count() if made.columns == ["a", "b"] else 0))[0])
    passage = " ".join(f"p{i}" for i in range(104))
    docs = [(n, passage + "".join(f" u{n}x{i}" for i in range(13))) for n in range(80)]
    alike = " ".join(f"q{i}" for i in range(104))
    docs += [(100 + n, alike + "".join(f" v{n}x{i}" for i in range(9))) for n in range(40)]
    _, pairs = kept_by_hand(docs)
    assert pairs == {(a, b) for a in range(100, 140) for b in range(a + 1, 140)}
    found = {(r.a, r.b) for r in shingles.links(spark.createDataFrame(docs, "node long, text string")).collect()}
    assert found <= pairs and max(sizes) <= len(docs)
    parent = {n: n for n in range(100, 140)}
    for a, b in sorted(found, key=lambda p: p[1]):
        old, new = parent[b], parent[a]
        parent = {n: new if g == old else g for n, g in parent.items()}
    assert len(set(parent.values())) == 1

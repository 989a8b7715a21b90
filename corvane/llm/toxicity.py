"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on at most, those of the smallest hash; different
#: labelled sentences among them for the field's weights, the most frequent first; words and stems it knows.
FIT_DOCUMENTS, FIT_SENTENCES, FIT_FEATURES = 12_000, 40_000, 20_000
#: Lengths of the stems of a word.
STEMS = (4, 5, 6, 7)
#: Documents from which on a word is judged by itself, not by its stems.
OWN = 4
#: Evidence (log odds) of a word is cut at these values into the symbols 1, 2, ...; 0 is a word with less. Below the first,
#: a word may stand for a language or a kind of text with somewhat more toxic documents.
CUTS = (1.5, 2.25, 3.0, 4.0, 5.0)
#: Words of a sequence: a sentence, or so many words of a longer one.
SEQUENCE = 128
#: Marginal from which a word is part of an offending span.
SPAN = 0.5
#: Words whose symbol a worker remembers.
CACHE_ENTRIES = 400_000
#: Characters scored together, which bounds what a worker holds at a time.
BATCH_CHARS = 2_000_000
#: Score from which a document is predicted toxic.
THRESHOLD = 0.3

_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")
_ROUNDS, _RATE, _RIDGE = 60, 0.3, 1e-4


def held_out(doc_id: Column) -> Column:
    """Whether labels of a document may not be learned from; a null identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _features(word: str) -> list[str]:
    """The word (with its end marked) and its stems."""
    return [word + "|", *(word[:k] for k in STEMS if len(word) >= k)]


@dataclass(frozen=True)
class Model:
    """What scoring needs: evidence by word and stem, the field's weights, the document layer."""

    evidence: dict[str, float]
    emission: np.ndarray  # symbols x states
    transition: np.ndarray  # states x states
    start: np.ndarray  # states
    document: np.ndarray  # weights of document_features
    prior: float  # share of toxic documents, for texts without words

    def symbols(self) -> "_Symbols":
        return _Symbols(self.evidence)


class _Symbols(dict):
    """The symbol of each word, worked out once; -1 for the end of a sentence."""

    def __init__(self, evidence: dict[str, float]) -> None:
        super().__init__(dict.fromkeys(_STOPS, -1))
        self._evidence = evidence

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.update(dict.fromkeys(_STOPS, -1))
        own, *stems = _features(word)
        known = self._evidence.get(own)  # a word that was seen often enough speaks for itself
        evidence = max([0.0, *(self._evidence.get(s, 0.0) for s in stems)]) if known is None else known
        self[word] = found = sum(evidence > c for c in CUTS)
        return found


@dataclass(frozen=True)
class Sequences:
    """Sequences of one length after another, longest first: symbols lie position by position, so one step handles all sequences at once."""

    symbols: np.ndarray
    words: np.ndarray  # where each symbol stands among the words given
    sizes: list[int]  # sequences that have a word at each position

    def offsets(self) -> list[int]:
        return [0, *np.cumsum(self.sizes).tolist()]


def sequences(marks: np.ndarray) -> Sequences:
    """From symbols of words with -1 at ends of sentences (and documents)."""
    words = np.flatnonzero(marks >= 0)
    sentence = np.cumsum(marks < 0)[words]
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    lengths = np.diff(np.append(starts, len(words)))
    within = np.arange(len(words)) - np.repeat(starts, lengths)
    chunk = np.flatnonzero(within % SEQUENCE == 0)  # sentences of more words go on in another sequence
    size = np.diff(np.append(chunk, len(words)))
    rank = np.empty(len(chunk), np.int64)
    rank[np.argsort(-size, kind="stable")] = np.arange(len(chunk))
    order = np.lexsort((np.repeat(rank, size), within % SEQUENCE))
    sizes = np.bincount(within % SEQUENCE).tolist() if len(words) else []
    return Sequences(marks[words][order].astype(np.int64), order, sizes)


def marginals(seq: Sequences, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward and backward passes: P(toxic) of each symbol in the sequences' order, log of each position's scale, and P(state, next state) of
    each symbol but the last of a sequence, for the first sizes[t + 1] sequences of each position t."""
    at = seq.offsets()
    local = np.exp(model.emission)[seq.symbols]
    step = np.exp(model.transition)
    forward, backward, scale = np.empty_like(local), np.ones_like(local), np.empty(len(local))
    for t, n in enumerate(seq.sizes):
        rows = slice(at[t], at[t] + n)
        came = np.exp(model.start)[None, :] if t == 0 else forward[at[t - 1] : at[t - 1] + n] @ step
        values = came * local[rows]
        scale[rows] = values.sum(axis=1)
        forward[rows] = values / scale[rows, None]
    for t in range(len(seq.sizes) - 2, -1, -1):
        n = seq.sizes[t + 1]
        after = slice(at[t + 1], at[t + 1] + n)
        backward[at[t] : at[t] + n] = ((local[after] * backward[after]) / scale[after, None]) @ step.T
    both = forward * backward
    toxic = both[:, 1] / both.sum(axis=1)
    pairs = [np.zeros((0, 2, 2))]
    for t in range(len(seq.sizes) - 1):
        n = seq.sizes[t + 1]
        here, after = slice(at[t], at[t] + n), slice(at[t + 1], at[t + 1] + n)
        pairs.append(forward[here][:, :, None] * step[None] * ((local[after] * backward[after]) / scale[after, None])[:, None, :])
    return toxic, np.log(scale), np.concatenate(pairs)


def fit_field(counted: list[tuple[bytes, bool, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission, transition and start weights of greatest likelihood for (symbols, toxic document, times) sentences.

    The labelled tokens: in a toxic document the words with evidence are toxic, all other words are
    clean. The likelihood's gradient is observed less expected counts of states and of pairs of
    states, climbed with a step per weight (Adam).
    """
    marks, states, weights = [], [], []
    for symbols, toxic, times in counted:
        s = np.frombuffer(symbols, np.int8).astype(np.int64)
        marks += [s, [-1]]
        states.append(((s > 0) & toxic).astype(np.int64))
        weights.append(np.full(len(s), float(times)))
    seq = sequences(np.concatenate(marks))
    state, weight = np.concatenate(states)[seq.words], np.concatenate(weights)[seq.words]
    weight /= weight.sum()
    at = seq.offsets()
    n_symbols = len(CUTS) + 1
    here = np.concatenate([np.arange(at[t], at[t] + seq.sizes[t + 1]) for t in range(len(seq.sizes) - 1)] or [np.zeros(0, np.int64)])
    after = np.concatenate([np.arange(at[t + 1], at[t + 1] + seq.sizes[t + 1]) for t in range(len(seq.sizes) - 1)] or [np.zeros(0, np.int64)])
    first = slice(0, seq.sizes[0])

    def counts(toxic: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        one = np.bincount(seq.symbols, weights=weight * toxic, minlength=n_symbols)
        zero = np.bincount(seq.symbols, weights=weight * (1 - toxic), minlength=n_symbols)
        begin = [(weight[first] * (1 - toxic[first])).sum(), (weight[first] * toxic[first]).sum()]
        return np.concatenate([np.stack([zero, one], axis=1).ravel(), (weight[here][:, None, None] * pairs).sum(axis=0).ravel(), begin])

    truth = np.zeros((len(here), 2, 2))
    truth[np.arange(len(here)), state[here], state[after]] = 1
    observed = counts(state.astype(float), truth)

    def split(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return w[: 2 * n_symbols].reshape(-1, 2), w[2 * n_symbols : 2 * n_symbols + 4].reshape(2, 2), w[-2:]

    w = np.zeros(2 * n_symbols + 6)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for turn in range(1, _ROUNDS + 1):
        toxic, _, pairs = marginals(seq, Model({}, *split(w), np.zeros(4), 0.0))
        slope = observed - counts(toxic, pairs) - _RIDGE * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w + _RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    return split(w)


def document_features(total: np.ndarray, most: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A constant, the expected number of toxic words, their share, and the surest word's marginal."""
    return np.stack([np.ones(len(total)), np.log(total + 0.05), np.log((total + 0.02) / (n_words + 10)), most], axis=1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_documents(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(30):
        p = _logistic(features @ w)
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, features.T @ (toxic - p) - 0.1 * w)
    return w


def _lower(text: str | None) -> str:
    """Lower case of the same length: the dotted capital I alone would become two characters."""
    return (text or "").replace("\u0130", "i").lower()


def _tokens(text: str | None) -> list[str]:
    return _TOKENS.findall(_lower(text))


@dataclass(frozen=True)
class Found:
    """Of a batch of documents: expected toxic words, surest marginal, words, and the marginals of each word in order of the text."""

    total: np.ndarray
    most: np.ndarray
    n_words: np.ndarray
    marginal: np.ndarray
    ends: np.ndarray


def tag(texts: list[str | None], model: Model, symbols: _Symbols) -> Found:
    marks: list[int] = []
    ends = np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        marks += map(symbols.__getitem__, _tokens(text))
        marks.append(-1)
        ends[i] = len(marks)
    line = np.array(marks, np.int64)
    seq = sequences(line)
    marginal = np.zeros(int((line >= 0).sum()))
    if len(marginal):
        marginal[seq.words] = marginals(seq, model)[0]
    stops = np.cumsum(line >= 0)[ends - 1]
    n_words = np.diff(stops, prepend=0)
    sums = np.concatenate([[0.0], np.cumsum(marginal)])
    total = np.maximum(sums[stops] - sums[stops - n_words], 0)
    most = np.zeros(len(texts))
    filled = n_words > 0
    if filled.any():
        most[filled] = np.maximum.reduceat(marginal, (stops - n_words)[filled])
    return Found(total, most, n_words, marginal, stops)


def _spans(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of neighbouring words of a marginal of ``SPAN`` or more: start, end (exclusive, in characters of the text) and the greatest marginal."""
    spans: list[dict] = []
    follows = False
    words = (m for m in _TOKENS.finditer(_lower(text)) if m[0] not in _STOPS)
    for m, p in zip(words, marginal.tolist(), strict=True):
        if p < SPAN:
            follows = False
        elif follows:
            spans[-1] |= {"end": m.end(), "marginal": max(p, spans[-1]["marginal"])}
        else:
            spans.append({"start": m.start(), "end": m.end(), "marginal": p})
            follows = True
    return spans


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have a word or stem, toxic and clean ones apart."""
    for b in batches:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for i in range(b.num_rows):
            words = set(_tokens(b.column(0)[i].as_py())) - _STOPS
            held[b.column(1)[i].as_py()].update({f for w in words for f in _features(w)})
        names = list(held[0].keys() | held[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([held[1][n] for n in names], pa.int64()), pa.array([held[0][n] for n in names], pa.int64())], names=["feature", "toxic", "clean"])


def _evidence(counts: DataFrame, n_toxic: int, n_clean: int, most: int) -> dict[str, float]:
    """What speaks for toxicity: log odds less their standard error, of features whose count is no chance among as many as there
    are; and of words that were seen ``OWN`` times, where one of their stems is such a feature."""
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("toxic") + F.col("clean")
    log = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    gain = 2 * (log(F.col("toxic"), both * share) + log(F.col("clean"), both * (1 - share)))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    evidence = odds - F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    tried = max(counts.where("toxic > 1").count(), 2)
    weighed = counts.withColumns({"gain": gain, "evidence": evidence, "seen": both})
    telling = weighed.where((F.col("gain") > 2 * math.log(tried)) & (F.col("evidence") > CUTS[0])).orderBy(F.desc("gain"), "feature").limit(most)
    found = {r[0]: r[1] for r in telling.select("feature", "evidence").collect()}
    stems = counts.sparkSession.createDataFrame([(f,) for f in found if not f.endswith("|")], "stem string")  # at most `most` rows
    own = weighed.where(F.col("feature").endswith("|") & (F.col("seen") >= OWN))
    own = own.select("feature", "evidence", "seen", F.explode(F.array(*[F.substring("feature", 1, k) for k in STEMS])).alias("stem")).join(F.broadcast(stems), "stem")
    own = own.select("feature", "evidence", "seen").distinct().orderBy(F.desc("seen"), "feature").limit(most)
    return found | {r[0]: r[1] for r in own.select("feature", "evidence").collect()}


def labelled(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """text and toxic (boolean) of the labelled documents to learn from: not held out, at most ``fit_documents``, those of the smallest hash of doc_id.

    Several labels of a document count as toxic if one of them is; null labels and identifiers are none.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic"))
    drawn = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_documents)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return named.join(F.broadcast(drawn), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")  # a bounded number of short rows


def train(docs: DataFrame, labels: DataFrame, store: Callable[[DataFrame], DataFrame], fit_documents_: int = FIT_DOCUMENTS, fit_sentences: int = FIT_SENTENCES, fit_features: int = FIT_FEATURES) -> Model:
    """The model from the labelled documents (see :func:`labelled`), which ``store`` keeps; only bounded tables reach the driver.

    Words and stems are counted in Spark; the field is fitted on different sentences with their
    number of times, the document layer on three numbers of each document. Without both labels the model knows no word and all scores are the prior.
    """
    rows = store(labelled(docs, labels, fit_documents_))
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(True, 0), n.get(False, 0)
    prior = (n_toxic + 1) / (n_toxic + n_clean + 10)
    counts = rows.select("text", "toxic").mapInArrow(_counting, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    evidence = _evidence(store(counts), n_toxic, n_clean, fit_features) if n_toxic and n_clean else {}
    flat = np.zeros((len(CUTS) + 1, 2))
    if not evidence:
        return Model({}, flat, np.zeros((2, 2)), np.zeros(2), np.zeros(4), prior)

    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = _Symbols(evidence)
        for b in batches:
            held: Counter = Counter()
            for i in range(b.num_rows):
                marks = np.array([*map(symbols.__getitem__, _tokens(b.column(0)[i].as_py())), -1], np.int8)
                for piece in np.split(marks, np.flatnonzero(marks < 0)):
                    piece = piece[piece >= 0]
                    for k in range(0, len(piece), SEQUENCE):
                        held[piece[k : k + SEQUENCE].tobytes(), b.column(1)[i].as_py()] += 1
            keys = list(held)
            yield pa.record_batch([pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([held[k] for k in keys], pa.int64())], names=["symbols", "toxic", "times"])

    seen = rows.mapInArrow(sentences, "symbols binary, toxic boolean, times long").groupBy("symbols", "toxic").agg(F.sum("times").alias("times"))
    kept = seen.orderBy(F.desc("times"), F.xxhash64("symbols"), "symbols", "toxic").limit(fit_sentences).collect()
    emission, transition, start = fit_field([(bytes(r[0]), r[1], r[2]) for r in kept])
    field = Model(evidence, emission, transition, start, np.zeros(4), prior)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = field.symbols()
        for b in batches:
            found = tag(b.column(0).to_pylist(), field, symbols)
            yield pa.record_batch([pa.array(found.total), pa.array(found.most), pa.array(found.n_words), b.column(1)], names=["total", "most", "n_words", "toxic"])

    table = rows.mapInArrow(numbers, "total double, most double, n_words long, toxic boolean").toArrow()
    total, most, n_words, toxic = (table.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    order = np.lexsort((total, n_words, toxic))  # sums do not depend on how rows were dealt
    weights = fit_documents(document_features(total, most, n_words)[order], toxic.astype(float)[order])
    return Model(evidence, emission, transition, start, weights, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and spans (start, end, marginal of each offending run of words, offsets in characters) of every whole text.

    A word is a run of letters in lower case. Words get marginals within their sentence; a document's
    expected number of toxic words, their share and the surest one make the score. A text without
    words, null ones included, has the share of toxic documents as its score and no span. Repeated
    rows each appear, whatever their identifier; an empty table gives no rows. Other columns are not read.
    """

    def answers(ids: list, texts: list[str], symbols: _Symbols) -> pa.RecordBatch:
        found = tag(texts, model, symbols)
        if model.evidence:
            scores = _logistic(document_features(found.total, found.most, found.n_words) @ model.document)
            scores[found.n_words == 0] = model.prior
        else:
            scores = np.full(len(texts), model.prior)
        spans = [_spans(t, found.marginal[e - n : e]) if m >= SPAN else [] for t, m, e, n in zip(texts, found.most, found.ends, found.n_words, strict=True)]
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(scores), pa.array(spans, _SPANS)], names=["doc_id", "score", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = model.symbols()
        ids: list = []
        texts: list[str] = []
        size = 0
        for b in batches:
            for i in range(b.num_rows):
                ids.append(b.column(0)[i].as_py())
                texts.append(b.column(1)[i].as_py() or "")
                size += len(texts[-1])
                if size >= BATCH_CHARS:
                    yield answers(ids, texts, symbols)
                    ids, texts, size = [], [], 0
        if ids:
            yield answers(ids, texts, symbols)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start:long,end:long,marginal:double>>")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def toxicity_report(docs: DataFrame, labels: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of ``THRESHOLD`` on) of every document, by a model of ``labels`` (doc_id, toxic)."""
    found = score(docs, train(docs, labels, store))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

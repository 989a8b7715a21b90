"""Language identification by rank-order profiles of n-grams.

N-grams are of one to three letters, within words padded with a blank at either end.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.windows import one_by_one

#: N-grams of a profile, of a language and of a document alike.
PROFILE = 400
UNDETERMINED = "und"

#: Characters counted together while learning.
LEARN_CHARS = 1_000_000

_OTHER = re.compile(r"[\W\d_]+")


def _ngrams(text: str) -> np.ndarray:
    """The n-grams of a whole text's words, repeats included, each as its code points in 21 bits apiece."""
    words = f" {_OTHER.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    blank = c == 32
    pairs = (c[:-1] << 21) | c[1:]
    triples = ((pairs[:-1] << 21) | c[2:])[~blank[1:-1]]  # none across a blank
    return np.concatenate([c[~blank], pairs, triples])


def _ranked(text: str) -> np.ndarray:
    """A text's most frequent n-grams, ties in order of the code."""
    grams, counts = np.unique(_ngrams(text), return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, gram (a code) and rank (from 0): the most frequent n-grams of each language over all rows.

    Workers count the n-grams of the documents they read, Spark sums the counts by language
    and n-gram, and the ``PROFILE`` most frequent stay, ties in order of the n-gram. Rows whose
    language or text is null are not learnt from. The result has ``PROFILE`` rows a language at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = defaultdict(list)
        size: Counter = Counter()

        def batch(lang: str) -> pa.RecordBatch:
            counted = pd.Series(_ngrams(" ".join(texts.pop(lang)))).value_counts(sort=False)
            del size[lang]
            columns = [pa.array([lang] * len(counted)), pa.array(counted.index, pa.int64()), pa.array(counted, pa.int64())]
            return pa.record_batch(columns, names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in one_by_one(b):
                texts[lang].append(text)
                size[lang] += len(text)
                if size[lang] > LEARN_CHARS:
                    yield batch(lang)
        for lang in list(texts):
            yield batch(lang)

    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(first) - 1)
        .where(F.col("rank") < PROFILE)
        .select("lang", "gram", "rank")
    )


class Classifier:
    """Compares a document's profile with each language's by out-of-place distance.

    An n-gram costs the difference of its two ranks, and ``PROFILE`` where the language
    lacks it. The nearest language wins, the first by name of equally near ones; the score
    is 1 minus the distance over the largest possible one.
    """

    def __init__(self, profiles: list[tuple[str, int, int]]) -> None:
        self.languages = sorted({lang for lang, _, _ in profiles})
        column = {lang: i for i, lang in enumerate(self.languages)}
        self._grams = np.array(sorted({g for _, g, _ in profiles}) or [0], np.int64)
        self._ranks = np.full((len(self._grams) + 1, len(self.languages)), -1, np.int32)  # the last row: n-grams of no language
        for lang, g, rank in profiles:
            self._ranks[np.searchsorted(self._grams, g), column[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        grams = _ranked(text)
        at = np.minimum(np.searchsorted(self._grams, grams), len(self._grams) - 1)
        ranks = self._ranks[np.where(self._grams[at] == grams, at, -1)]
        apart = np.abs(ranks - np.arange(len(ranks), dtype=np.int32)[:, None])
        total = np.where(ranks < 0, PROFILE, apart).sum(axis=0)
        best = int(total.argmin())
        return self.languages[best], float(1 - total[best] / (PROFILE * len(ranks)))


def classifier(profiles: DataFrame) -> Column:
    """A function of a text column that gives struct(lang_pred, score); the profiles are small and sent out once."""
    sent = profiles.sparkSession.sparkContext.broadcast([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()])

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(sent.value)
        for s in texts:
            yield pd.DataFrame([model.predict(t) for t in s], columns=["lang_pred", "score"])

    return predict


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the identifier as text leaves 2 on division by 4; false for a null one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    Profiles are learnt from all rows that are not held out. The prediction is ``und`` with
    score 0 for a text that is null or has no letter, and for every text where nothing could be
    learnt. Repeated rows get the same prediction; an empty table gives no rows. Other columns
    are not read.
    """
    profiles = learn_profiles(docs.where(~held_out(id_col)), lang_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), classifier(profiles)(F.col(text_col)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without rows that have no language: no letter, or no n-gram of any profile. All columns unchanged."""
    profiles = learn_profiles(docs.where(~held_out(id_col)), lang_col, text_col)
    found = docs.withColumn("__found", classifier(profiles)(F.col(text_col)))
    return found.where((F.col("__found.lang_pred") != UNDETERMINED) & (F.col("__found.score") > 0)).drop("__found")

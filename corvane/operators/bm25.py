"""A stored inverted index with BM25 weights, ordered by weight so that the tail of a frequent term is not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import lexical

K1, B = 1.2, 0.75
#: Weights are whole numbers of this part of 1, so that sums are exact and equal everywhere.
UNIT = 1_000_000
#: Rows of a term that are tried first for each row wanted; four times as many each time they do not suffice.
FIRST = 8
#: Rows of a row group's page: what a scan can leave out.
PAGE_ROWS = 2000
#: The most tokens that are sent to all tasks with their frequencies: those that have more than this part of the postings.
FREQUENT = 100_000
#: Texts whose tokens a task counts at a time.
BATCH_ROWS = 1000
FIELDS = ("name", "body")
_TOKEN = "[a-z0-9_]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different token of a text, with how often and where it stands; a text's tokens need no shuffle to meet."""
    for whole in batches:
        for start in range(0, whole.num_rows, BATCH_ROWS):
            b = whole.slice(start, BATCH_ROWS)
            size = pc.list_value_length(b.column("tokens")).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = b.column("tokens").flatten().dictionary_encode()
            row = np.repeat(np.arange(b.num_rows), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            key = row * len(codes.dictionary) + codes.indices.to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.append(first, len(order))
            text, at = pa.array(row[order[first]]), pa.array(order[first])
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
            yield pa.record_batch(
                [b.column("field").take(text), codes.dictionary.take(codes.indices.take(at)), b.column("id").take(text), b.column("length").take(text), pa.array(np.diff(ends)), places],
                names=["field", "token", "id", "length", "tf", "places"],
            )


def build(elements: DataFrame, folder: str) -> None:
    """Write the index of (id, name, raw_text) under ``folder``: postings, terms and sizes.

    A posting is (field, token, id, weight, places); postings lie in order of field, token and falling weight, and
    ranges are cut by all three, so a token that a third of the elements hold spreads over several files. A
    term is (field, token, df, top, ladder): falling weights, each reached by about four times as many postings, the last by all.
    """
    texts = elements.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("text")) for f, c in zip(FIELDS, ("name", "raw_text"), strict=True)])).alias("x"))
    said = texts.select("id", "x.field", tokens(F.coalesce("x.text", F.lit(""))).alias("tokens")).withColumn("length", F.size("tokens"))
    sizes = said.groupBy("field").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    sizes.coalesce(1).write.parquet(f"{folder}/sizes")
    kind = dict(said.dtypes)["id"]
    held = said.select("field", "id", "length", "tokens").mapInArrow(_counted, f"field string, token string, id {kind}, length int, tf long, places array<int>")
    held.write.parquet(f"{folder}/counts")
    spark = elements.sparkSession
    held, sizes = spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/sizes")
    held.groupBy("field", "token").agg(F.count("*").alias("df")).write.parquet(f"{folder}/frequencies")
    df = spark.read.parquet(f"{folder}/frequencies")
    # tokens of many postings are few and go to all tasks; only the others' postings are dealt to be joined
    least = (df.agg(F.sum("df")).first()[0] or 0) // FREQUENT + 1
    often = F.broadcast(df.where(F.col("df") >= least))
    rest = held.join(often, ["field", "token"], "left_anti").join(df.where(F.col("df") < least), ["field", "token"])
    rows = held.join(often, ["field", "token"]).unionByName(rest).join(F.broadcast(sizes), "field")  # one row for each field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / (F.col("total") / F.col("n"))))
    weighed = rows.select("field", "token", "id", F.round(score * UNIT).cast("long").alias("weight"), "places")
    ordered = weighed.repartitionByRange("field", "token", F.desc("weight"), "id").sortWithinPartitions("field", "token", F.desc("weight"), "id")
    ordered.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings").select("field", "token", "weight")
    # equal weights count together, so a rung needs no row of its own number; few weights of a token differ from all others
    counted = stored.groupBy("field", "token", "weight").agg(F.count("*").alias("n"))
    down = Window.partitionBy("field", "token").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, 0)
    reach = F.sum("n").over(down)
    rung = lambda x: F.greatest(F.ceil(F.log(4.0, x / FIRST) - 1e-12), F.lit(0))  # noqa: E731  the rung that a posting of this number stands on
    numbered = counted.select("field", "token", "weight", "n", rung(reach).alias("rung"))
    rungs = numbered.groupBy("field", "token", "rung").agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.sum("n").alias("n"))
    terms = rungs.groupBy("field", "token").agg(F.sum("n").alias("df"), F.max("most").alias("top"), F.transform(F.array_sort(F.collect_list(F.struct("rung", "least"))), lambda x: x["least"]).alias("ladder"))
    terms.repartitionByRange("field", "token").sortWithinPartitions("field", "token").write.parquet(f"{folder}/terms")


@dataclass(frozen=True)
class Index:
    """An index that was built before, opened by its folder."""

    postings: DataFrame
    terms: DataFrame


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _in_order(n: int) -> Column:
    """Whether the places p0, p1, ... of n words have one where they follow each other."""
    def start(i: int) -> Column:
        return F.transform(f"p{i}", lambda p: p - i)

    starts = [start(i) for i in range(n)]
    return F.size(reduce(F.array_intersect, starts)) > 0


def _fits(word: str, phrase: bool) -> Column:
    return F.col("token") == word if phrase else F.col("token").startswith(word)


def _scored(index: Index, words: list[str], bounds: dict[str, int], field: str, phrase: bool) -> DataFrame:
    """id and score of the elements that hold every word with at least the weight it is bound to."""
    wanted = index.postings.where((F.col("field") == field) & _any([_fits(w, phrase) & (F.col("weight") >= b) for w, b in bounds.items()]))
    each = []
    for i, w in enumerate(words):
        each.append(F.max(F.when(_fits(w, phrase) & (F.col("weight") >= bounds[w]), F.col("weight"))).alias(f"w{i}"))
        if phrase:
            each.append(F.first(F.when(_fits(w, phrase), F.col("places")), ignorenulls=True).alias(f"p{i}"))
    rows = wanted.groupBy("id").agg(*each).where(reduce(lambda a, b: a & b, [F.col(f"w{i}").isNotNull() for i in range(len(words))]))
    if phrase:
        rows = rows.where(_in_order(len(words)))
    return rows.select("id", reduce(lambda a, b: a + b, [F.col(f"w{i}") for i in range(len(words))]).alias("score"))


def bounds(index: Index, words: list[str], k: int, field: str = "body", phrase: bool = False) -> dict[str, int] | None:
    """The least weight that each word's postings need to have for the ``k`` best elements; none if a word has no posting.

    The heads of the words' lists are read first, by a weight from their ladders, until they hold k
    elements in full. The k-th score bounds from below what each word of a better element has to weigh.
    """
    per_word = index.terms.where((F.col("field") == field) & _any([_fits(w, phrase) for w in set(words)]))
    known = {}
    for w in dict.fromkeys(words):
        mine = per_word.where(_fits(w, phrase)).agg(F.max("top").alias("top"), F.max(F.size("ladder")).alias("height"), F.collect_set("ladder").alias("ladders"))
        known[w] = mine.first()
        if known[w]["top"] is None:
            return None

    def rung(w: str, n: int) -> int:
        """A weight that about FIRST * 4**n postings of each token of the word reach, or all of them."""
        return min(ladder[min(n, len(ladder) - 1)] for ladder in known[w]["ladders"])

    n, last = 0, max(r["height"] for r in known.values()) - 1
    while FIRST * 4**n < k and n < last:
        n += 1
    while True:
        found = {w: rung(w, n) for w in known}
        best = _scored(index, words, found, field, phrase).orderBy(F.desc("score"), "id").limit(k).collect()  # k rows
        if len(best) >= k or n >= last:
            break
        n += 1
    if len(best) >= k:
        most = sum(known[w]["top"] for w in words)  # a word may stand twice in a phrase
        found = {w: max(best[-1]["score"] - (most - known[w]["top"]), rung(w, last)) for w in known}
    return found


def window(index: Index, words: list[str], k: int, field: str = "body", phrase: bool = False) -> DataFrame:
    """The ``k`` best elements that hold every word, as id and score (ties to the smaller id).

    A word is matched by every token that starts with it, and counts with the heaviest of them; for a
    ``phrase`` tokens are whole words that follow each other. Postings below the words' :func:`bounds` are not
    read: nothing is lost, and the tail of a frequent word stays on disk.
    """
    least = bounds(index, words, k, field, phrase) if words else None
    if least is None:
        return index.postings.sparkSession.createDataFrame([], "id long, score long")
    return _scored(index, words, least, field, phrase).orderBy(F.desc("score"), "id").limit(k)


def windows(index: Index, query: str, k: int, phrase: bool = True) -> DataFrame:
    """id of what the windows of a query find: all terms in the body, all in the name, the required terms in the body, the phrase."""
    terms = lexical.query_terms(query)
    must = lexical.required_terms(terms)
    found = []
    if terms:
        found = [window(index, terms, k), window(index, terms, k, "name")]
        if must != terms:
            found.append(window(index, must, k))
    if phrase or not terms:
        found.append(window(index, re.findall(_TOKEN, query.lower()), k, phrase=True))
    return reduce(DataFrame.unionAll, [f.select("id") for f in found]).distinct()


def search(elements: DataFrame, index: Index, query: str, filters: lexical.SearchFilters = lexical.SearchFilters(), phrase: bool = True) -> DataFrame:
    """The page of :func:`lexical.lexical_search` over what the windows find; each gives ``OVERFETCH`` rows for a row of the page.

    The ids, a bounded number, go to the scan of the elements, so only row groups that may hold them are read.
    """
    ids = [r[0] for r in windows(index, query, filters.limit * lexical.OVERFETCH, phrase).collect()]
    return lexical.lexical_search(elements.where(F.col("id").isin(ids) if ids else F.lit(False)), query, filters)

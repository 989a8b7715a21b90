"""Lexical search: every required term verbatim, ranked by where it stands."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Question and auxiliary words that a match need not hold.
QUESTION_WORDS = frozenset(
    """how why what when where which who whom whose did does are was were has have had can could would should will""".split()
)
MAX_TERMS, LEAST_TERM = 8, 3
#: Ranked rows looked at for each row of a page before hidden ones are dropped.
OVERFETCH = 10
HIDDEN_CLASSES = ("retrieval_call", "retrieval_result")
KINDS = {
    "code": ("file", "container", "function"),
    "doc": ("section", "row"),
    "conversation": ("turn",),
    "all": ("file", "container", "function", "section", "turn", "row"),
}


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of a query, longest first, at most eight."""
    words = (re.sub(r"^[^\w]+|[^\w]+$", "", w).lower() for w in query.split())
    return sorted(dict.fromkeys(w for w in words if len(w) >= LEAST_TERM), key=len, reverse=True)[:MAX_TERMS]


def required_terms(terms: list[str]) -> list[str]:
    """The terms that must occur: all but question words, unless there is nothing else."""
    return [t for t in terms if t not in QUESTION_WORDS] or terms


@dataclass(frozen=True)
class SearchFilters:
    """What a search is limited to; unset means no limit, and adds no predicate."""

    source: str = "all"
    kinds: tuple[str, ...] = ()
    address_prefix: str | None = None
    hidden_classes: tuple[str, ...] = HIDDEN_CLASSES
    limit: int = 10
    offset: int = 0
    min_score: float | None = None
    extra: tuple[Column, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.source not in KINDS:
            raise ValueError(f"unknown source {self.source!r}")
        if not 1 <= self.limit <= 100 or self.offset < 0:
            raise ValueError("limit is 1 to 100, offset 0 or more")
        if self.min_score is not None and not 0 <= self.min_score <= 1:
            raise ValueError("min_score is 0 to 1")

    @property
    def fetch(self) -> int:
        """Rows a leg of the search ranks, one more than a page shows, so that the page knows whether there are more."""
        return max(self.offset + self.limit + 1, 101)

    def apply(self, elements: DataFrame) -> DataFrame:
        kinds = self.kinds or (KINDS[self.source] if self.source != "all" else ())
        wanted = [F.col("kind").isin(*kinds)] if kinds else []
        if self.address_prefix:
            wanted.append(F.col("address").startswith(self.address_prefix))
        return reduce(DataFrame.where, [*wanted, *self.extra], elements)


def density(length: Column) -> Column:
    """A bonus below 0.04 for short texts."""
    return F.lit(0.04) / (1 + F.log(1 + length / 2000.0))


def scored(elements: DataFrame, query: str, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """Matching elements with score, name_match and hidden; none for a query under three characters."""
    phrase, terms = query.strip().lower(), query_terms(query)
    must = required_terms(terms)
    rows = filters.apply(elements).withColumns({"__t": F.lower(F.concat_ws("\n", "name", "raw_text")), "__n": F.lower("name")})
    within = lambda column, words: reduce(lambda a, b: a & b, [column.contains(w) for w in words])
    text, name = F.col("__t"), F.col("__n")
    if len(phrase) < LEAST_TERM:
        return rows.where(F.lit(False)).withColumns({"score": F.lit(0.0), "name_match": F.lit(False), "hidden": F.lit(False)}).drop("__t", "__n")
    bonus = density(F.length("raw_text"))
    exact = (F.col("kind") != "turn") & ((name == phrase) | text.contains(phrase))
    in_name = within(name, must) if must else F.lit(False)
    score = (
        F.when(exact, 1.0)
        .when(in_name, 0.90 + bonus)
        .when(text.contains(phrase), 0.80 + bonus)
        .when(within(text, terms) if terms else F.lit(False), 0.65 + bonus)
        .otherwise(0.60 + bonus)
    )
    hit = within(text, must) if must else text.contains(phrase)
    hidden = F.coalesce(F.col("turn_class").isin(*filters.hidden_classes), F.lit(False)) if filters.hidden_classes else F.lit(False)
    return (
        rows.where(hit)
        .withColumns({"score": F.round(score, 9), "name_match": in_name, "hidden": hidden})
        .drop("__t", "__n")
    )


def ranking() -> list[Column]:
    return [F.desc("score"), F.desc("name_match"), F.length("raw_text"), F.col("id")]


def lexical_search(elements: DataFrame, query: str, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """The best ``limit`` visible matches among the first ``OVERFETCH`` times as many, with their rank from 1."""
    best = scored(elements, query, filters).select("id", "kind", "name", "address", "score", "name_match", "hidden", F.length("raw_text").alias("n"))
    order = [F.desc("score"), F.desc("name_match"), "n", "id"]
    window = best.orderBy(*order).limit(filters.limit * OVERFETCH)  # bounded by the request
    seen = window.where(~F.col("hidden")).orderBy(*order).limit(filters.limit)
    return seen.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("n", "hidden")


def hidden_count(elements: DataFrame, query: str, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """One row, also for an empty page: how many of the ranked window's rows are hidden and shown."""
    best = scored(elements, query, filters).select("id", "score", "name_match", "hidden", F.length("raw_text").alias("n"))
    window = best.orderBy(F.desc("score"), F.desc("name_match"), "n", "id").limit(filters.limit * OVERFETCH)
    return window.agg(F.count_if("hidden").alias("hidden"), F.count_if(~F.col("hidden")).alias("shown"))


def pages(elements: DataFrame, query: str, scope: Column, filters: SearchFilters = SearchFilters()) -> DataFrame:
    """The scoped page and the wide one from a single scored pass, tagged by ``page``."""
    found = scored(elements, query, filters).withColumn("__in", F.coalesce(scope, F.lit(False)))
    tagged = found.withColumn("page", F.explode(F.when(F.col("__in"), F.array(F.lit("scoped"), F.lit("wide"))).otherwise(F.array(F.lit("wide")))))
    order = Window.partitionBy("page").orderBy(*ranking())
    return tagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= filters.limit).select("page", "rank", "id", "name", "score")

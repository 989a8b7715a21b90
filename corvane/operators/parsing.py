"""Elements from text: markdown sections, tokens and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane import scratch

LEVELS = 6
#: Width of the deterministic stand-in for an embedding model.
WIDTH = 32


def sections(docs: DataFrame, key: str, markdown: Column) -> DataFrame:
    """key, start, stop, level and title of each heading's section: it ends before the next heading of its level or above.

    Headings inside fenced blocks are none. Each document's lines are sorted once; the next heading
    of each level comes from one window per level, so no heading meets another.
    """
    lines = docs.select(key, F.posexplode(F.split(markdown, "\n")).alias("at", "line"))
    order = Window.partitionBy(key).orderBy("at")
    fence = F.col("line").rlike("^ {0,3}```")
    inside = F.sum(fence.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    level = F.when(F.col("line").rlike("^#{1,6} ") & ~fence & (F.coalesce(inside, F.lit(0)) % 2 == 0), F.length(F.regexp_extract("line", "^(#+)", 1)))
    marked = lines.withColumn("level", level)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    nexts = {f"__n{n}": F.min(F.when(F.col("level") <= n, F.col("at"))).over(ahead) for n in range(1, LEVELS + 1)}
    last = F.max("at").over(Window.partitionBy(key))
    rows = marked.withColumns({**nexts, "__last": last}).where("level IS NOT NULL")
    end = F.coalesce(*[F.when(F.col("level") == n, F.col(f"__n{n}")) for n in range(1, LEVELS + 1)])
    title = F.trim(F.regexp_replace("line", "^#+ ", ""))
    return rows.select(key, (F.col("at") + 1).alias("start"), F.coalesce(end, F.col("__last") + 1).alias("stop"), "level", title.alias("title"))


def postings(elements: DataFrame) -> DataFrame:
    """token and id, once each: the inverted index that prunes a lexical search."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws("\n", "name", "raw_text")), F.lit("[a-z0-9_]+"), F.lit(0)))
    return elements.select("id", F.explode(tokens).alias("token"))


def stored_index(elements: DataFrame) -> DataFrame:
    """The postings as a table sorted by token, so that a term's prefix skips the row groups without it.

    Ranges are cut by token and id: a token that a third of the elements hold spreads over several files.
    """
    return scratch.kept(postings(elements).repartitionByRange("token", "id").sortWithinPartitions("token", "id"))


def candidates(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids of elements where each term starts a token; the prefixes reach the scan."""
    hits = [F.max(F.col("token").startswith(t).cast("int")) for t in terms]
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | F.col("token").startswith(t)
    found = index.where(wanted).groupBy("id").agg(*[h.alias(f"t{i}") for i, h in enumerate(hits)])
    for i in range(len(terms)):
        found = found.where(F.col(f"t{i}") == 1)
    return found.select("id")


def embed(column: str) -> Column:
    """A deterministic unit vector of a text: its words' hashes add or take one in a place each. It stands in for a model."""
    import zlib

    import numpy as np

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(WIDTH, np.float32)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                v[h % WIDTH] += 1 if h >> 16 & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return vectors(F.col(column))

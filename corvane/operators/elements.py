"""Vector search for elements: what may answer, which of it is nearest, and where that stands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators import gates, maintenance, provenance, vector

RAW, SMART = "raw", "smart"


@dataclass(frozen=True)
class Admission:
    """What an answer has to be; unset parts admit all. ``version`` is the parser whose elements stand for a blob that it has parsed."""

    version: str
    kinds: tuple[str, ...] = ()
    schema: str | None = None
    source_kind: str | None = None

    def __post_init__(self) -> None:
        if self.source_kind not in (None, RAW, SMART):
            raise ValueError(f"unknown source kind {self.source_kind!r}")


def candidates(vectors: DataFrame, elements: DataFrame, summaries: DataFrame, rule: Admission) -> DataFrame:
    """Elements with the vectors that speak for them: of their own text, or of a summary of it.

    Vectors are (vector_id, source_kind, source_hash, chunk_no, embedding), elements (id, kind, blob_sha, parser_version,
    raw_hash, parent_id, schema), summaries (raw_hash, text_hash, model, created). A file with children has no say through its own
    text, as they have; of summaries with one text the oldest speaks.
    """
    current = maintenance.current_parses(elements, rule.version)
    wanted = lambda rows: rows.where(F.col("kind").isin(*rule.kinds) if rule.kinds else F.lit(True)).where(F.col("schema") == rule.schema if rule.schema is not None else F.lit(True))
    named = ["id", "kind", "blob_sha", "raw_hash"]
    carried = ["vector_id", "source_kind", "chunk_no", "embedding"]
    raw = wanted(gates.without_container_files(current)).select(*named).join(vectors.where(F.col("source_kind") == RAW).withColumnRenamed("source_hash", "raw_hash"), "raw_hash").select(*named, *carried)
    order = Window.partitionBy("text_hash").orderBy("created", "model", "raw_hash")
    said = summaries.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(F.col("text_hash").alias("source_hash"), "raw_hash")
    smart = vectors.where(F.col("source_kind") == SMART).join(said, "source_hash").join(wanted(current).select(*named), "raw_hash").select(*named, *carried)
    if rule.source_kind:
        return raw if rule.source_kind == RAW else smart
    return raw.unionAll(smart)


def search(vectors: DataFrame, elements: DataFrame, summaries: DataFrame, places: DataFrame, asked: list[float], rule: Admission, limit: int, min_score: float | None = None) -> DataFrame:
    """id, kind, score, source_kind, identity, root_path, path and rank of the ``limit`` best elements.

    An element counts with its nearest vector, and of elements with one text the best stands for all. Everything that may not
    answer is gone before the ranking, so a small scope still fills its page; places are looked up for the page only.
    """
    score = F.round(F.least(F.lit(1.0), vector.cosine(F.col("embedding"), vector.literal(asked))), 6)
    scored = candidates(vectors, elements, summaries, rule).select("id", "kind", "blob_sha", "raw_hash", "source_kind", "chunk_no", "vector_id", score.alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    first = F.struct(-F.col("score"), "source_kind", "chunk_no", "vector_id")
    nearest = scored.groupBy("id", "kind", "blob_sha", "raw_hash").agg(F.max("score").alias("score"), F.min_by("source_kind", first).alias("source_kind"))
    one = nearest.groupBy("raw_hash").agg(F.min_by(F.struct("id", "kind", "blob_sha", "score", "source_kind"), F.struct(-F.col("score"), "id")).alias("x")).select("x.*")
    order = [F.desc("score"), F.col("id")]
    page = one.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    standing = provenance.representative(places.join(page.select("blob_sha").distinct(), "blob_sha", "left_semi"))
    return page.join(standing.select("blob_sha", "identity", "root_path", "path"), "blob_sha", "left").drop("blob_sha")

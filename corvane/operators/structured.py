"""Structured documents: JSON texts with sections, whose rows stand at any depth."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane import scratch

#: Fields of a row that are no text of it.
NO_TEXT = ("id", "state")
#: Levels of a document that one pass walks down.
LEVELS = 8


@dataclass(frozen=True)
class Fields:
    """What a schema declares of a section's rows: fields of prose, and fields that only give context."""

    prose: tuple[str, ...] = field(default=())
    context: tuple[str, ...] = field(default=())


def _string(node: str | Column, path: str) -> Column:
    """The string at a path of a variant; null if there is none or it is of another type."""
    value = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(node, path, "string"))


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and doc (a variant, null where the text is null or no JSON; what follows a complete value is not looked at)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.try_parse_json(text_col).alias("doc"))


def unparseable(docs: DataFrame) -> DataFrame:
    """doc_id of the :func:`parsed` documents that are no JSON."""
    return docs.where("doc IS NULL").select("doc_id")


def _exploded(df: DataFrame, column: str) -> DataFrame:
    """A row with pos, key (null in arrays) and value for each item of an object or array; scalars and nulls have none."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(column).outer()))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, schema, sweep_excluded, section_no, section (its name), value and title for each named section of :func:`parsed` documents.

    The title is that of the first section called ``meta`` that has one.
    """
    listed = docs.select("doc_id", "doc", F.try_variant_get("doc", "$.sections", "variant").alias("list"))
    named = F.transform(F.try_variant_get("list", "$", "array<variant>"), lambda x: F.struct(_string(x, "$.name").alias("name"), _string(x, "$.value.title").alias("title")))
    title = F.get(F.filter(named, lambda x: (x["name"] == "meta") & x["title"].isNotNull()), F.lit(0))["title"]
    excluded = F.try_variant_get("doc", "$.dd.sweep_exclude", "variant")
    heads = listed.select(
        "doc_id",
        F.coalesce(_string("doc", "$.dd.schema"), F.lit("")).alias("schema"),
        F.coalesce(F.when(F.schema_of_variant(excluded) == "BOOLEAN", F.try_variant_get("doc", "$.dd.sweep_exclude", "boolean")), F.lit(False)).alias("sweep_excluded"),
        title.alias("title"),
        F.when(F.try_variant_get("list", "$", "array<variant>").isNotNull(), F.col("list")).alias("list"),  # an object has no sections
    )
    each = _exploded(heads, "list").withColumn("section", _string("value", "$.name")).where("section IS NOT NULL")
    return each.select("doc_id", "schema", "sweep_excluded", F.col("pos").alias("section_no"), "section", F.try_variant_get("value", "$.value", "variant").alias("value"), "title")


def _field_lines(node: str, names: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.concat(F.lit(f"{prefix}{n}: "), _string(node, f"$.{n}")) for n in names]


def _row_text(declared: dict[str, Fields] | None) -> tuple[Column, Column]:
    """The text of a row and what it is made of: its parents, then declared fields, or all strings of a row if nothing is declared."""
    parents = F.slice("trail", 1, F.greatest(F.size("trail") - 1, F.lit(0)))
    lead = F.when(F.size(parents) > 0, F.array_join(parents, " / "))
    if declared is None:
        texts = F.filter(F.map_entries(F.try_variant_get("node", "$", "map<string,variant>")), lambda e: ~e["key"].isin(*NO_TEXT) & (F.schema_of_variant(e["value"]) == "STRING"))
        lines = F.array_sort(F.transform(texts, lambda e: F.struct(e["key"].alias("key"), F.concat(e["key"], F.lit(": "), F.try_variant_get(e["value"], "$", "string")).alias("line"))))
        return F.concat_ws("\n", lead, F.array_join(F.transform(lines, lambda x: x["line"]), "\n")), F.lit("fallback")
    text = F.concat_ws("\n", lead)
    for name, fields in declared.items():
        text = F.when(F.col("section") == name, F.concat_ws("\n", lead, *_field_lines("node", fields.prose, ""), *_field_lines("node", fields.context, "context "))).otherwise(text)
    return text, F.lit("schema")


def _walked(level: DataFrame) -> DataFrame:
    """``LEVELS`` levels further down from nodes that are no rows: the rows on the way with their id, and what is left below, without one.

    A row is carried along as it is, so the levels are one pass over the documents and nothing is stored between them.
    """
    level = level.withColumn("id", _string("node", "$.id"))
    for _ in range(LEVELS):
        below = level.withColumn("open", F.when(F.col("id").isNull(), F.col("node")))
        each = below.lateralJoin(below.sparkSession.tvf.variant_explode_outer(F.col("open").outer()))
        each = each.where("id IS NOT NULL OR value IS NOT NULL")  # scalars and empty nodes end here
        old = F.col("id").isNotNull()
        same = [c for c in each.columns if c not in ("trail", "place", "node", "id", "open", "pos", "key", "value")]
        level = each.select(
            *same,
            F.when(old | F.col("key").isNull(), F.col("trail")).otherwise(F.array_append("trail", F.col("key"))).alias("trail"),
            F.when(old, F.col("place")).otherwise(F.array_append("place", F.col("pos"))).alias("place"),
            F.when(old, F.col("node")).otherwise(F.col("value")).alias("node"),
            F.when(old, F.col("id")).otherwise(_string("value", "$.id")).alias("id"),
        )
    return level


def _found(level: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of every row below the nodes of a level; the passes are kept in the shared folder, without what is below a row."""
    found: list[DataFrame] = []
    while True:
        passed = _walked(level).withColumn("row", F.col("id").isNotNull()).withColumn("trail", F.when(F.col("row"), F.array_append("trail", F.col("id"))).otherwise(F.col("trail")))
        rest = F.when(~F.col("row") & F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)"), F.struct(*level.columns))
        done = scratch.kept(passed.select(F.when(F.col("row"), F.struct(*columns)).alias("made"), rest.alias("rest")).where("made IS NOT NULL OR rest IS NOT NULL"))
        found.append(done.where("made IS NOT NULL").select("made.*"))
        level = done.where("rest IS NOT NULL").select("rest.*")
        if level.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return every


def rows(docs: DataFrame, declared: dict[str, Fields] | None = None) -> DataFrame:
    """One row for each row of :func:`parsed` documents: an object with a string ``id``, wherever it stands below a section.

    doc_id, schema, sweep_excluded, title, section, trail (section, keys on the way, id), sibling_order (from 0 in
    each section, in the order of the text with keys sorted), state, text and basis. Rows do not
    nest: what is below one is part of it. ``LEVELS`` levels of all documents are walked in one pass, and
    what lies deeper in further ones, until nothing is left: no depth is too deep.
    """
    carried = ["doc_id", "schema", "sweep_excluded", "title", "section_no", "section"]
    level = sections(docs).select(*carried, F.array("section").alias("trail"), F.array("section_no").alias("place"), F.col("value").alias("node"))
    text, basis = _row_text(declared)
    every = _found(level, [*[F.col(c) for c in carried], F.col("trail"), F.col("place"), _string("node", "$.state").alias("state"), text.alias("text")])
    order = F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("place")) - 1
    return every.select("doc_id", "schema", "sweep_excluded", "title", "section", "trail", order.alias("sibling_order"), "state", "text", basis.alias("basis"))


def holders(docs: DataFrame) -> DataFrame:
    """doc_id and section (its name) of the sections of :func:`parsed` documents that hold rows, once for each row."""
    level = sections(docs).select("doc_id", "section", F.array("section").alias("trail"), F.array("section_no").alias("place"), F.col("value").alias("node"))
    return _found(level, [F.col("doc_id"), F.col("section")])


def section_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, section and text (name, then the string or the compact JSON) of the sections that hold none of the ``found`` rows."""
    each = sections(docs)
    value = F.coalesce(_string("value", "$"), F.to_json("value"))
    plain = each.join(found.select("doc_id", "section").distinct(), ["doc_id", "section"], "left_anti")
    return plain.select("doc_id", "section", F.concat_ws("\n", "section", value).alias("text"))

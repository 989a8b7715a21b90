"""Secret scans with corpus-wide ownership frequency (native expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.storage import stored

# Fixed patterns of the base scan: kind, pattern, group that holds the value, and its least length.
# A match is found first and then dropped if it is too short, so it uses up its text either way.
BASE = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Shorter runs match neither kind, so these find the same spans in fewer steps.
_QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: What the method adds: long runs of letters and digits outside the base spans that few owners share.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
ADDED = "owned"
#: Owners, or repositories of whatever owners, from which a value counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6
#: Parts into which the rows of one value are divided where its counts go back to them.
SALTS = 64


def _found(text: Column, kind: str, number: int, pattern: str, group: int) -> Column:
    """A pattern's matches in turn: number in the text, characters since the match before, length and value."""
    zipped = F.arrays_zip(
        F.transform(F.split(text, pattern), F.char_length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    made = F.transform(
        F.filter(zipped, lambda x: x["match"].isNotNull()),  # what follows the last match has none
        lambda x, i: F.struct(F.lit(number).alias("place"), F.lit(kind).alias("kind"), i.alias("number"), x["gap"].alias("gap"), F.char_length(x["match"]).alias("width"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<place:int,kind:string,number:int,gap:int,width:int,value:string>>"))


def _spans(rows: DataFrame) -> DataFrame:
    """row, owner, repository, and start, place, stop, kind and value of every base span, and of added ones that overlap none.

    The matches of a text are rows here. Running sums give their places and running extremes what
    overlaps, so the work is in proportion to the matches, or n log n for their sort.
    """
    so_far = Window.partitionBy("row", "place").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.select("row", "owner", "repository", F.explode("found").alias("m"))
        .select("row", "owner", "repository", "m.*")
        .withColumn("stop", F.sum(F.col("gap") + F.col("width")).over(so_far).cast("int"))
        .withColumn("start", F.col("stop") - F.col("width"))
    )
    long_enough = F.lit(False)
    for i, (_, _, _, least) in enumerate(BASE):
        long_enough = long_enough | ((F.col("place") == i) & (F.char_length("value") >= least))
    added = F.col("place") == len(BASE)
    fitting = placed.where(long_enough | (added & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")))
    by_start = Window.partitionBy("row").orderBy("start")
    reached = F.max(F.when(~added, F.col("stop"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    follows = F.min(F.when(~added, F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    overlaps = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(follows < F.col("stop"), F.lit(False))
    kept = fitting.withColumn("overlaps", overlaps).where(~(added & F.col("overlaps")))
    return kept.select("row", "owner", "repository", F.struct("start", "place", "stop", "kind", "value").alias("span"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, spans, n_live and n_example of every whole text.

    ``spans`` holds (start, place, stop, kind, value) in order of start and kind: every base
    span, and of the added candidates those that are owner-specific. Each value, base or added,
    is counted by its distinct owners and repositories over all rows: one with ``EXAMPLE_OWNERS``
    or more owners, or ``EXAMPLE_REPOSITORIES`` or more repositories, is an example that was copied
    around (n_example), any other a credential that looks live (n_live).

    A null text counts as empty, a null owner or repository as one of its own. Repeated rows and
    identifiers each keep a row of their own; an empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    repository = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_cols])
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), repository.alias("repository"), text.alias("body"))
    body = F.col("body")
    found = F.concat(*[_found(body, kind, i, _QUICK.get(kind, pattern), group) for i, (kind, pattern, group, _) in enumerate(BASE)], _found(body, ADDED, len(BASE), CANDIDATE, 0))
    # the row number is drawn once, and the rows stored with it
    rows = stored(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", found.alias("found")))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    values = stored(_spans(rows.where(F.size("found") > 0)).withColumn("hash", F.sha2("span.value", 256)).withColumn("salt", salt))

    holders = values.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    counts = holders.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    known = values.select("hash", "salt").distinct().join(counts, "hash")  # at most `SALTS` rows a value
    told = values.join(known, ["hash", "salt"])
    live = (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)
    added = F.col("span.kind") == ADDED
    by_row = told.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(~added, F.col("span")))).alias("base"),
        F.array_sort(F.collect_list(F.when(live | ~added, F.col("span")))).alias("spans"),
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_example"),
    )
    none = F.array().cast(by_row.schema["base"].dataType)
    return rows.select("row", "doc_id").join(by_row, "row", "left").select(
        "doc_id",
        F.coalesce("base", none).alias("base"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def scan_report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:stop), n_live and n_example from :func:`scan`."""
    of_kind = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[of_kind(kind) for kind, *_ in BASE],
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        _digest(F.col("spans")).alias("spans"),
        "n_live",
        "n_example",
    )


def _sql_spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    pattern = "'" + pattern.replace("'", "''") + "'"
    return f"""
        SELECT row, owner, repository, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
                 start := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                 place := {number}, width := length(m[i]), kind := '{kind}', value := v[i]))) AS s
        FROM (SELECT row, owner, repository, regexp_extract_all(body, {pattern}, 0) AS m, regexp_extract_all(body, {pattern}, {group}) AS v,
                     string_split_regex(body, {pattern}) AS g FROM docs)"""


SCAN_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository,
                     coalesce(text, '') AS body FROM documents),
flat AS (SELECT row, owner, repository, CAST(s.start AS BIGINT) AS start, s.place AS place, CAST(s.start + s.width AS BIGINT) AS stop, s.kind AS kind, s.value AS value FROM (
         {" UNION ALL ".join(_sql_spans(kind, i, pattern, group, least) for i, (kind, pattern, group, least) in enumerate(BASE))}
         UNION ALL {_sql_spans(ADDED, len(BASE), CANDIDATE, 0, 20)})),
base AS (SELECT * FROM flat WHERE {" OR ".join(f"(kind = '{kind}' AND length(value) >= {least})" for kind, _, _, least in BASE)}),
loose AS (SELECT * FROM flat f WHERE kind = '{ADDED}' AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
          AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = f.row AND b.start < f.stop AND f.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
counts AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT struct_pack(o := owner, r := repository)) AS repositories FROM every GROUP BY value),
told AS (SELECT every.*, owners >= {EXAMPLE_OWNERS} OR repositories >= {EXAMPLE_REPOSITORIES} AS example, kind || ':' || start || ':' || stop AS said FROM every JOIN counts USING (value)),
by_row AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                  string_agg(said, ',' ORDER BY start, place) FILTER (kind <> '{ADDED}') AS base,
                  string_agg(said, ',' ORDER BY start, place) FILTER (kind <> '{ADDED}' OR NOT example) AS spans,
                  count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_example FROM told GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM docs LEFT JOIN by_row USING (row)
"""

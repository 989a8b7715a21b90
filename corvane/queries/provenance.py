"""Provenance, paths and the read surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.model import Tables, with_views
from corvane.operators import provenance
from corvane.queries import query


@query(
    with_views(
        "SELECT identity, root_path, path, blob_sha, element_id FROM (SELECT *, row_number() OVER (PARTITION BY blob_sha ORDER BY identity, root_path, path) AS n FROM locations) WHERE n = 1", "locations"
    )
)
def representative_location(t: Tables) -> DataFrame:
    return provenance.representative(t.locations)


@query(with_views("SELECT id, name, raw_hash FROM elements WHERE raw_hash IN (SELECT blob_sha FROM locations WHERE identity = 'src3' AND path LIKE 'en/d3/%')", "turns", "elements", "locations"))
def scope_semi_join(t: Tables) -> DataFrame:
    return provenance.admitted(t.elements, provenance.owned(t.locations, identity="src3", glob="en/d3/*")).select("id", "name", "raw_hash")


@query(
    with_views(
        """SELECT id, kind FROM elements WHERE raw_hash IN (SELECT blob_sha FROM locations WHERE root_path = 'src2/de')
        OR raw_hash IN (SELECT sha256(body) FROM turns WHERE conv_id % 5 = 0)""",
        "turns",
        "elements",
        "locations",
    )
)
def scope_union(t: Tables) -> DataFrame:
    turns = t.turns.where(F.col("conv_id") % 5 == 0).select(F.sha2("body", 256).alias("blob_sha"))
    return provenance.admitted(t.elements, provenance.owned(t.locations, root_path="src2/de"), turns).select("id", "kind")


@query(with_views("SELECT bool_or(path LIKE 'fr/d_/1%') AS matched, count(*) FILTER (path LIKE 'fr/d_/1%') AS n, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT split_part(path, '/', 1) AS x FROM locations)) AS tops FROM locations", "locations"))
def path_probe(t: Tables) -> DataFrame:
    return provenance.path_probe(t.locations, "fr/d?/1*")


@query(with_views("SELECT identity, path, blob_sha FROM locations WHERE path = 'en/d2' OR starts_with(path, 'en/d2/')", "locations"))
def files_under(t: Tables) -> DataFrame:
    return t.locations.where(provenance.path_prefix(F.col("path"), "en/d2")).select("identity", "path", "blob_sha")


@query(with_views("SELECT split_part(substring(path, 4), '/', 1) AS entry, count(*) AS files FROM locations WHERE starts_with(path, 'en/') GROUP BY 1", "locations"))
def tree_children(t: Tables) -> DataFrame:
    return provenance.children(t.locations, "en")


@query(
    with_views(
        """, roots AS (SELECT DISTINCT root_path FROM locations UNION SELECT DISTINCT identity FROM locations WHERE identity < 'src5'),
        paths AS (SELECT DISTINCT root_path || '/' || path AS path FROM locations UNION SELECT 'lost/' || path FROM locations WHERE element_id < 20)
        SELECT path, (SELECT root_path FROM roots r WHERE p.path = r.root_path OR starts_with(p.path, r.root_path || '/') ORDER BY length(root_path) DESC LIMIT 1) AS root_path FROM paths p""".lstrip(", "),
        "locations",
    )
)
def longest_root(t: Tables) -> DataFrame:
    places = t.locations
    roots = places.select("root_path").union(places.where(F.col("identity") < "src5").select("identity")).distinct()
    paths = places.select(F.concat("root_path", F.lit("/"), "path").alias("path")).union(places.where("element_id < 20").select(F.concat(F.lit("lost/"), "path"))).distinct()
    return provenance.longest_root(paths, roots)


@query(with_views("SELECT identity, count(*) AS files, count(DISTINCT blob_sha) AS blobs, count(DISTINCT root_path) AS worktrees FROM locations GROUP BY identity", "locations"))
def repository_files(t: Tables) -> DataFrame:
    return t.locations.groupBy("identity").agg(F.count("*").alias("files"), F.count_distinct("blob_sha").alias("blobs"), F.count_distinct("root_path").alias("worktrees"))


@query(with_views("SELECT count(DISTINCT (identity, path)) AS n FROM locations", "locations"))
def distinct_paths(t: Tables) -> DataFrame:
    return t.locations.agg(F.count_distinct("identity", "path").alias("n"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 40 AS target, count(*) AS n_refs, min(event_id) AS first_ref FROM events GROUP BY 1")
def refs_to_file(t: Tables) -> DataFrame:
    target = F.get_json_object("props", "$.k").cast("long") % 40
    return t.events.groupBy(target.alias("target")).agg(F.count("*").alias("n_refs"), F.min("event_id").alias("first_ref"))


@query(with_views("SELECT blob_sha, string_agg(path, ',' ORDER BY path) AS paths, count(*) AS n FROM locations GROUP BY blob_sha HAVING count(*) > 1", "locations"))
def paths_per_blob(t: Tables) -> DataFrame:
    return t.locations.groupBy("blob_sha").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"), F.count("*").alias("n")).where("n > 1")

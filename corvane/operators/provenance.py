"""Provenance: where content lives, who owns it, and which place stands for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def representative(locations: DataFrame, key: str = "blob_sha") -> DataFrame:
    """The first place of each content by repository, worktree and path, nulls last."""
    order = [F.col(c).asc_nulls_last() for c in ("identity", "root_path", "path")]
    return locations.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def path_prefix(path: Column, prefix: str) -> Column:
    """A path or what lies below it; never a sibling that only starts alike."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/")


def glob_to_like(glob: str) -> str:
    """A LIKE pattern, with ``\\`` as its escape, for a glob; open at the end unless the glob ends in a star."""
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            while glob[i : i + 1] == "*":
                i += 1
            out += "%"
            continue
        out += {"?": "_"}.get(glob[i], "\\" + glob[i] if glob[i] in "\\%_" else glob[i])
        i += 1
    return out if glob.endswith("*") else out + "%"


def owned(locations: DataFrame, identity: str | None = None, root_path: str | None = None, glob: str | None = None) -> DataFrame:
    """Distinct contents held by a live path in the scope; unset parts add no predicate."""
    rows = locations
    if identity is not None:
        rows = rows.where(F.col("identity") == identity)
    if root_path is not None:
        rows = rows.where(F.col("root_path") == root_path)
    if glob is not None:
        rows = rows.where(F.col("path").like(glob_to_like(glob)))
    return rows.select("blob_sha").distinct()


def admitted(elements: DataFrame, *scopes: DataFrame) -> DataFrame:
    """Elements whose content one of the scopes holds: a union of keys and one semi-join."""
    keys = scopes[0]
    for s in scopes[1:]:
        keys = keys.unionByName(s)
    return elements.join(keys.select(F.col("blob_sha").alias("raw_hash")).distinct(), "raw_hash", "left_semi")


def longest_root(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root_path") -> DataFrame:
    """For each path the longest root that contains it, or null: each ancestor is an equality join, not a scan of all roots."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    wide = paths.select(path, F.explode(ancestors).alias(root))
    found = wide.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.select(path).distinct().join(found, path, "left")


def path_probe(locations: DataFrame, glob: str) -> DataFrame:
    """One row: whether the glob matches anything, how often, and the top directories there are."""
    hit = F.col("path").like(glob_to_like(glob))
    return locations.agg(F.bool_or(hit).alias("matched"), F.count_if(hit).alias("n"), F.array_join(F.array_sort(F.collect_set(F.split_part("path", F.lit("/"), F.lit(1)))), ",").alias("tops"))


def children(locations: DataFrame, under: str, depth: int = 1) -> DataFrame:
    """Entries ``depth`` levels below a directory, with how many files each holds."""
    rest = F.expr(f"substring(path, {len(under.rstrip('/')) + 2})")
    rows = locations.where(path_prefix(F.col("path"), under)).select(F.array_join(F.slice(F.split(rest, "/"), 1, depth), "/").alias("entry"))
    return rows.groupBy("entry").agg(F.count("*").alias("files"))

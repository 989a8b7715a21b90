"""What a question is about: which repository and worktree it is asked of, or everything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import repository_key
from corvane.operators.provenance import longest_root

EVERYTHING = "all"


def resolve_scopes(asks: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Asks (ask_id, repo, cwd, checkout) with scope_repo, worktree, source and warning; a null scope_repo is everything.

    A repository named in any spelling comes first; "all" in any case is everything. Else the longest root of ``worktrees``
    (identity, root_path) that holds ``cwd`` decides, else ``checkout``, the identity of what lies there if it is a checkout of
    a known repository. Warnings: not-indexed (a named or checked-out repository is unknown), unregistered-checkout (known
    from elsewhere), outside-roots. Blank names and folders count as null.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    remote = lambda c: c.contains("://") | c.rlike(r"^[^/@\s]+@[^/:]+:")
    named = filled("repo")
    asks = asks.withColumns({"named": F.when(remote(named), F.concat(F.lit("git:"), repository_key(named))).otherwise(named), "cwd": filled("cwd")})
    roots = worktrees.groupBy("root_path").agg(F.min("identity").alias("root_identity"))
    placed = longest_root(asks.where("cwd IS NOT NULL"), roots, "cwd").join(roots, "root_path", "left")
    known = worktrees.select("identity").distinct()
    found = asks.join(placed, "cwd", "left")
    found = found.join(known.select(F.col("identity").alias("named"), F.lit(True).alias("named_known")), "named", "left")
    found = found.join(known.select(F.col("identity").alias("checkout"), F.lit(True).alias("checkout_known")), "checkout", "left")

    flagged, everything = F.col("named").isNotNull(), F.lower("named") == EVERYTHING
    by_name, inside = flagged & ~everything, ~flagged & F.col("root_path").isNotNull()
    outside = ~flagged & F.col("root_path").isNull() & F.col("cwd").isNotNull()
    by_checkout = outside & F.col("checkout_known").isNotNull()
    return found.select(
        "ask_id",
        F.when(by_name, F.col("named")).when(inside, F.col("root_identity")).when(by_checkout, F.col("checkout")).alias("scope_repo"),
        F.when(inside, F.col("root_path")).alias("worktree"),
        F.when(by_name, "flag").when(inside | by_checkout, "cwd").otherwise("everything").alias("source"),
        F.when(by_name & F.col("named_known").isNull(), "not-indexed")
        .when(by_checkout, "unregistered-checkout")
        .when(outside & F.col("checkout").isNotNull(), "not-indexed")
        .when(outside, "outside-roots")
        .alias("warning"),
    )

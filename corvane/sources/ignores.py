"""Ignore rules of a tree: inherited down its directories, the last match of the nearest rule file wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pattern(rule: Column) -> Column:
    """A rule without its marks as a regular expression on the path below the rule's directory.

    A slash inside a rule ties it to that directory; without one the rule is for names at any depth.
    """
    tied = F.contains(rule, F.lit("/"))
    bare = F.regexp_replace(rule, "^/", "")
    text = F.regexp_replace(bare, r"([.+^$(){}|])", r"\\$1")
    text = F.replace(text, F.lit("[!"), F.lit("[^"))
    # stand-ins, so that one star is not taken for a part of two
    for mark, stand in (("**/", "\u0001"), ("/**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", "/.*")):
        text = F.replace(text, F.lit(mark), F.lit(stand))
    return F.concat(F.when(tied, "^").otherwise("(?:^|/)"), text, F.lit("$"))


def rules(files: DataFrame) -> DataFrame:
    """root, dir, line, pattern, negated and dir_only of the rules in rule files (root, dir, text); dir is ``''`` at the root.

    Blank lines and comments are none, blanks at a rule's end do not count, and a backslash takes the meaning of a leading ``#`` or ``!``.
    """
    lines = files.select("root", "dir", F.posexplode(F.split("text", "\r?\n")).alias("line", "said"))
    lines = lines.withColumn("said", F.regexp_replace("said", r"\s+$", "")).where("said <> '' AND NOT startswith(said, '#')")
    negated = F.col("said").startswith("!")
    rule = F.regexp_replace(F.when(negated, F.substr("said", F.lit(2))).otherwise(F.col("said")), r"^\\([#!])", "$1")
    dir_only = rule.endswith("/")
    return lines.select("root", "dir", "line", _pattern(F.regexp_replace(rule, "/+$", "")).alias("pattern"), negated.alias("negated"), dir_only.alias("dir_only"))


def _parents(path: Column) -> Column:
    """The directories that a path lies in, the root as ``''`` first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def verdicts(paths: DataFrame, found: DataFrame) -> DataFrame:
    """(root, path) with ignored and by: the topmost directory on the way, or the file itself, that the :func:`rules` leave out.

    Every directory on the way is judged once for all paths below it. Nothing below an ignored directory comes back,
    whatever a rule further down says. A rule meets only what lies below its own directory.
    """
    chain = F.concat(F.transform(F.slice(_parents(F.col("path")), 2, 1 << 20), lambda d: F.struct(d.alias("node"), F.lit(True).alias("is_dir"))), F.array(F.struct(F.col("path").alias("node"), F.lit(False).alias("is_dir"))))
    ways = paths.select("root", "path", F.explode(chain).alias("x")).select("root", "path", "x.node", "x.is_dir")
    nodes = ways.select("root", "node", "is_dir").distinct()
    near = nodes.select("*", F.explode(_parents(F.col("node"))).alias("dir")).join(found, ["root", "dir"])
    below = F.when(F.col("dir") == "", F.col("node")).otherwise(F.substr("node", F.length("dir") + 2))
    hit = near.where((F.col("is_dir") | ~F.col("dir_only")) & F.rlike(below, F.col("pattern")))
    last = hit.groupBy("root", "node", "is_dir").agg(F.max_by("negated", F.struct(F.length("dir"), "line")).alias("negated"))
    out = ways.join(last.where("NOT negated").drop("negated").withColumn("out", F.lit(True)), ["root", "node", "is_dir"], "left")
    top = F.min(F.when(F.col("out"), F.struct(F.length("node").alias("n"), "node")))
    judged = out.groupBy("root", "path").agg(top["node"].alias("by"))
    return judged.select("root", "path", F.col("by").isNotNull().alias("ignored"), "by")


def below(paths: DataFrame, found: DataFrame, directory: str) -> DataFrame:
    """The :func:`verdicts` on what lies below one directory, the same as a walk of the whole tree would give."""
    return verdicts(paths.where(F.col("path").startswith(f"{directory}/")), found)


def pruned(judged: DataFrame) -> DataFrame:
    """root, dir and files: the directories that were not entered, and how many files lie below each."""
    return judged.where("ignored AND by <> path").groupBy("root", F.col("by").alias("dir")).agg(F.count("*").alias("files"))

"""Tags of communities from lists of tags, against those from single rows."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import labels

ROWS = [("x", 1, ["a", "a", "b"]), ("x", 2, ["a", "c"]), ("x", 3, []), ("y", 4, ["b", "b", "d"]), ("y", 5, ["d", "c", "c"]), ("y", 6, None), (None, 7, ["b"])]


@pytest.mark.parametrize("more", [[], [("x", 1, ["a", "c", "c"])], [("y", None, ["d"])]])
def test_lists_give_what_single_rows_give(spark, monkeypatch, more):
    listed = spark.createDataFrame(ROWS + more, "community string, member long, tags array<string>")
    want = labels.community_tags(listed.select("community", "member", F.explode("tags").alias("tag"))).collect()
    if not more:  # no tag of a member is shuffled for itself
        monkeypatch.setattr(labels, "community_tags", None)
    assert sorted(labels.listed_community_tags(listed).collect()) == sorted(want) and want

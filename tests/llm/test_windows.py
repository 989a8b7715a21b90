"""Second hashes of windows are compared in full."""

import numpy as np
import pytest

from corvane.llm import windows


@pytest.mark.parametrize("bit", [0, 39, 40, 63])
def test_parts_that_differ_in_one_bit_are_different(spark, bit):
    def hasher(rows):
        n = len(rows)
        parts = np.array([(1 << bit) if text == b"b" else 0 for text, *_ in rows], np.uint64)
        return windows.Windows(np.ones(n, np.int64), np.empty(0, np.int64), np.arange(n), np.full(n, 77, np.uint64), parts)

    docs = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 3, "b")], "doc_id long, key long, text string")
    found = {r.key: (r.later, r.check) for r in windows.sorted_places(docs, hasher, 3).collect()}
    assert found == {1: ([], [0]), 2: ([], [0]), 3: ([0], [])}

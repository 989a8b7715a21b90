"""Texts cut by bytes, between characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import head

# Bytes of a token, the share of a cap that is filled (two thirds), and a window and its overlap in tokens.
TOKEN_BYTES, FILLED, OF = 3, 2, 3
WINDOW_TOKENS, OVERLAP_TOKENS = 7500, 200
_LONGEST = 4  # bytes of a character


def budget_bytes(cap_tokens: int) -> int:
    return cap_tokens * FILLED // OF * TOKEN_BYTES


def fitted(text: Column, cap_tokens: int) -> Column:
    """The beginning of a text that a cap of tokens allows, one character at least; null if the whole text fits."""
    most = budget_bytes(cap_tokens)
    start = head(text, most)["head"] if most else F.lit("")
    return F.when(F.octet_length(text) > most, F.when(start != "", start).otherwise(F.left(text, F.lit(1))))


def _at_most(data: Column, n: Column) -> Column:
    """The last place up to byte ``n`` that is not inside a character."""
    inside = lambda i: F.hex(F.substring(data, i + 1, 1)).between("80", "BF")
    return F.when(~inside(n), n).when(~inside(n - 1), n - 1).when(~inside(n - 2), n - 2).otherwise(n - 3)


def windows(text: Column, window: int = budget_bytes(WINDOW_TOKENS), overlap: int = OVERLAP_TOKENS * TOKEN_BYTES) -> Column:
    """struct(start, stop, chunk) of the overlapping windows of a text, in bytes; one window for a text that fits in it.

    A window ends at the last character that is whole within ``window`` bytes of its start; the next one starts
    ``overlap`` bytes before that end, or less than a character earlier. The text is encoded once and the cuts are found in one pass.
    """
    least = window - overlap - 2 * (_LONGEST - 1)
    if least < 1:
        raise ValueError(f"a window has to be {2 * _LONGEST - 1} bytes or more longer than the overlap")

    def cut(data: Column) -> Column:
        size = F.octet_length(data)
        turns = F.when(size <= window, 1).otherwise(2 + F.floor((size - window) / least)).cast("int")
        begin = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<struct<start:int,stop:int>>").alias("cuts"))

        def step(state: Column, _: Column) -> Column:
            stop = F.when(state["start"] + window >= size, size).otherwise(_at_most(data, state["start"] + window))
            more = F.array_append(state["cuts"], F.struct(state["start"].alias("start"), stop.cast("int").alias("stop")))
            following = F.struct(_at_most(data, stop - overlap).cast("int").alias("start"), (stop >= size).alias("done"), more.alias("cuts"))
            return F.when(state["done"], state).otherwise(following)

        cuts = F.aggregate(F.sequence(F.lit(1), turns), begin, step)["cuts"]
        return F.transform(cuts, lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.decode(F.substring(data, c["start"] + 1, c["stop"] - c["start"]), "utf-8").alias("chunk")))

    return F.transform(F.array(F.encode(text, "utf-8")), cut)[0]  # a lambda's argument is worked out once

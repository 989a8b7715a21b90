"""Fuzzy line deduplication (native expressions only)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.components import components
from corvane.llm.storage import discard, stored

#: Differing bits up to which fingerprints are candidates, and the least edit similarity of a link.
DISTANCE, SIMILARITY = 3, 0.8
#: Of 6 blocks, 3 or fewer differing bits leave 3 equal: 20 keys of about 32 bits, in which unrelated
#: lines seldom meet up to billions of them. The lines of a key with more than ``MANY`` are keyed again by 5
#: of 8 blocks: 56 keys of 40 bits.
BLOCKS, FINE_BLOCKS, MANY = 6, 8, 32
#: Times that a crowded key's lines are compared with one drawn by a hash.
TURNS = 2
#: Eight counters of 8 bits to a long count the bits of lines of up to so many words.
NARROW = 127
_ONES = 0x0101010101010101
_LOW, _LOW_ONES, _LOW_TOPS = (1 << 56) - 1, _ONES >> 8, 0x80808080808080
#: The document number that stands for null, before all others.
_NULL_ID = -(1 << 63)

#: Edits that comparisons stop at, each a quarter more than the one before; more are counted out in full.
_BOUNDS = tuple(round(8 * 1.25**i) for i in range(36))

#: Edits that are tried before as many as are allowed.
_FEW = 24

_TEXT = {"compression": "zstd"}


def normalised(low: Column) -> Column:
    """Blanks within a line of a text in lower case as one space; ends of lines are trimmed after the split.

    Most texts have no blanks to join: the regular expression is for the others.
    """
    odd = low.contains("  ")
    for blank in "\t\x0b\f\r":
        odd = odd | low.contains(blank)
    return F.when(odd, F.regexp_replace(low, r" [ \t\x0B\f\r]+|[\t\x0B\f\r][ \t\x0B\f\r]*", " ")).otherwise(low)


def _document(id_col: str) -> Column:
    """The identifier, null as the smallest long."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (null as the smallest long), key (the text's hash), pos and norm of every line that is not blank."""
    texts = docs.select(_document(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.lower(text_col).alias("low"))  # a column of its own is worked out once
    lines = texts.select("doc", "key", F.posexplode(F.split(normalised(F.col("low")), "\n")).alias("pos", "line"))
    return lines.select("doc", "key", "pos", F.trim("line").alias("norm")).where("norm <> ''")


def _name(norm: str) -> Column:
    """128 bits of a line's SHA-256, by which lines are told apart."""
    return F.unhex(F.substring(F.sha2(norm, 256), 1, 32))


def _place() -> Column:
    """Documents in order, lines in order, as one number that a hash aggregate can take the least of."""
    return (F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31) + F.col("pos")).cast("decimal(38,0)")


def _packed(hashes: Column) -> Column:
    """c0 to c7: how many of up to ``NARROW`` hashes have each bit, eight counters to a long; bit 8i + b is the i-th of cb."""
    none = F.struct(*[F.lit(0).cast("long").alias(f"c{b}") for b in range(8)])
    return F.aggregate(hashes, none, lambda s, h: F.struct(*[(s[f"c{b}"] + F.shiftrightunsigned(h, b).bitwiseAND(F.lit(_ONES))).alias(f"c{b}") for b in range(8)]))


def _wide(hashes: Column) -> Column:
    """The majority of any number of hashes: counted by ``NARROW`` at a time, summed up in 64 longs."""
    parts = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(NARROW)), lambda i: F.slice(hashes, i + 1, NARROW))
    lane = lambda c, b: F.call_function("shiftrightunsigned", F.array(*[c[f"c{i}"] for i in range(8)])[b % 8], (b - b % 8)).bitwiseAND(F.lit(255).cast("long"))
    sums = F.aggregate(F.transform(parts, _packed), F.array_repeat(F.lit(0).cast("long"), 64), lambda s, c: F.transform(s, lambda n, b: n + lane(c, b)))
    ones = F.transform(sums, lambda n, b: F.when(2 * n > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(ones, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def fingerprints(lines: DataFrame) -> DataFrame:
    """``lines`` with bits, the SimHash of the different words of norm.

    Each different word has one vote, so a separator that fills half a line does not decide. A line's words
    are counted where it stands, so they make no rows and no shuffle. Lines of few words have eight counters to a
    long; their majorities are read off by adding what makes a counter's top bit one from half of the words on.
    """
    hashed = lines.withColumn("hashes", F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))))
    counted = hashed.withColumn("c", F.when(F.size("hashes") <= NARROW, _packed(F.col("hashes"))))
    half = F.shiftright(F.size("hashes").cast("long"), 1)
    lift = F.lit(_LOW_ONES) * (F.lit(127).cast("long") - half)
    bits = F.lit(0).cast("long")
    for b in range(8):
        tops = (F.col(f"c.c{b}").bitwiseAND(F.lit(_LOW)) + lift).bitwiseAND(F.lit(_LOW_TOPS))  # the highest counter apart: no sum overflows
        highest = F.when(F.shiftrightunsigned(f"c.c{b}", 56) > half, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        bits = bits.bitwiseOR(F.shiftleft(F.shiftrightunsigned(tops, 7).bitwiseOR(F.shiftleft(highest, 56)), b))
    return counted.withColumn("bits", F.when(F.col("c").isNotNull(), bits).otherwise(_wide(F.col("hashes")))).drop("hashes", "c")


def _masks(blocks: int) -> list[int]:
    bounds = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(prints: DataFrame, blocks: int) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(blocks), F.lit(i), F.col("bits").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(blocks))])
    return prints.select(F.explode(keys).alias("key"), "line", "bits", "n")


def _shared(prints: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of close lines that are alone in a key; and key, line, bits, held, and the most frequent line with its bits, of keys that more lines have.

    Most keys have one line: four numbers of a key tell them from those of two, the exclusive or of the bits being
    their difference. Only rows of the few larger keys are gathered. No key is counted before the shuffle, where hardly two of a task are equal.
    """
    keyed = _keyed(prints, blocks)
    sums = keyed.select("key", "line", "bits").repartition("key").groupBy("key").agg(F.count("*").alias("held"), F.min("line").alias("a"), F.max("line").alias("b"), F.bit_xor("bits").alias("apart"))
    counted = stored(sums.where((F.col("held") > 2) | ((F.col("held") == 2) & (F.bit_count("apart") <= DISTANCE))))
    larger = stored(counted.where("held > 2").select("key", "held"))  # a table of its own: it is small enough to be sent to the rows, mostly
    first = Window.partitionBy("key").orderBy(F.desc("n"), "line")
    return counted.where("held = 2").select("a", "b"), keyed.join(larger, "key").select(
        "key", "line", "bits", "n", "held", F.first("line").over(first).alias("centre"), F.first("bits").over(first).alias("centre_bits")
    )


def _common(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike, up to 2047."""
    alike = lambda at, n: F.substr(a, at + 1, n) == F.substr(b, at + 1, n)
    within = lambda at, n: at + n <= F.least(F.char_length(a), F.char_length(b))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(10, -1, -1)]), F.lit(0), lambda at, n: F.when(within(at, n) & alike(at, n), at + n).otherwise(at))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of lines whose edit similarity is high enough; edits beyond what it allows are not counted out.

    What two lines begin and end with alike takes no edits and is left out before they are counted. Nor are they counted
    where replacing the words that differ, one by one, takes no more than is allowed.
    """
    of = lambda c: texts.select(F.col("line").alias(c), F.col("norm").alias(f"n{c}"), F.char_length("norm").alias(f"l{c}"))
    allowed = F.floor((1 - similarity) * F.greatest("la", "lb") + 1e-9).cast("int")
    joined = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("allowed", allowed)
    joined = joined.where(F.abs(F.col("la") - F.col("lb")) <= F.col("allowed"))

    def beyond(x: Column) -> Column:
        """Both texts, each backwards, without their common beginning."""
        at = _common(x["a"], x["b"]) + 1
        return F.struct(F.reverse(F.substr(x["a"], at)).alias("a"), F.reverse(F.substr(x["b"], at)).alias("b"), x["allowed"].alias("allowed"))

    def settled(x: Column) -> Column:
        """Empty texts in place of those that need no count: all characters replaced, or those of the words that differ, are no more than is allowed."""
        one, two = F.split(x["a"], " "), F.split(x["b"], " ")
        longer = lambda p, q: F.greatest(F.char_length(p), F.char_length(q))
        worded = F.aggregate(F.zip_with(one, two, lambda p, q: F.when(p == q, F.lit(0)).otherwise(longer(p, q))), F.lit(0), lambda s, n: s + n)
        few = (longer(x["a"], x["b"]) <= x["allowed"]) | ((F.size(one) == F.size(two)) & (worded <= x["allowed"]))
        left = F.when(few, F.struct(F.lit("").alias("a"), F.lit("").alias("b"))).otherwise(F.struct(x["a"].alias("a"), x["b"].alias("b")))
        return F.struct(left.alias("left"), x["allowed"].alias("allowed"))

    def flat(x: Column) -> Column:
        return F.struct(x["left"]["a"].alias("a"), x["left"]["b"].alias("b"), x["allowed"].alias("allowed"))

    def few(x: Column) -> Column:
        """Few edits are tried first; -1 if there are more."""
        return F.struct(x["a"].alias("a"), x["b"].alias("b"), x["allowed"].alias("allowed"), F.levenshtein(x["a"], x["b"], _FEW).alias("found"))

    def edits(x: Column) -> Column:
        """levenshtein takes a constant threshold only, so allowed edits that are about as many go together."""
        found = F.levenshtein(x["a"], x["b"])
        for bound in reversed(_BOUNDS):
            found = F.when(x["allowed"] <= bound, F.levenshtein(x["a"], x["b"], bound)).otherwise(found)
        return F.when(x["found"] >= 0, x["found"]).otherwise(found)

    # a lambda's argument is worked out once, however often it is used
    counted = F.array(F.struct(F.col("na").alias("a"), F.col("nb").alias("b"), "allowed"))
    for step in (settled, flat, beyond, beyond, settled, flat, few, edits):
        counted = F.transform(counted, step)
    within = F.transform(counted, lambda n: n.between(0, F.col("allowed")))[0]
    return stored(joined.where(within).select("a", "b"))


def _near(x: str, y: str) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= DISTANCE


def _in_groups(shared: DataFrame, group: DataFrame) -> DataFrame:
    """The rows of ``shared`` with the component of the line so far, of keys whose lines are in several components."""
    grouped = shared.join(group, shared["line"] == group["node"], "left").withColumn("group", F.coalesce("component", "line")).drop("node", "component")
    whole = Window.partitionBy("key")
    several = F.min("group").over(whole) != F.max("group").over(whole)
    return stored(grouped.withColumn("several", several).where("several").drop("several"))


def _merged(group: DataFrame, links: DataFrame) -> DataFrame:
    """node and component of all that ``group`` or a further link names: only components that such links join are gone through again."""
    for c in ("a", "b"):
        ends = group.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        links = links.join(ends, c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
    links = stored(links)
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(group, "node", "left_anti")
    named = group.select("node", "component").unionAll(new.select("node", F.col("node").alias("component")))
    joined = components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return stored(named.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")))


def line_groups(prints: DataFrame, texts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """node and component (its smallest line) of lines that links of high edit similarity and close fingerprints connect with others.

    ``prints`` has line, n and bits; ``texts_of`` gives line and norm of the lines asked for. A key with many lines gives
    way to finer ones, which any two close fingerprints share as well. Lines of one key are compared with the key's
    most frequent line first, those of a crowded key then with others drawn by a hash, ``TURNS`` times. What is connected
    by then needs no more comparison, so only lines of different components are compared with all lines of the key.
    Texts are fetched once, for the lines that share a key with another.
    """
    two, coarse = _shared(prints, BLOCKS)
    coarse = stored(coarse)
    crowded = coarse.where(F.col("held") > MANY).select("line").distinct()
    fine_two, fine = _shared(stored(prints.join(crowded, "line", "left_semi")), FINE_BLOCKS)
    shared = stored(coarse.where(F.col("held") <= MANY).unionByName(fine))
    discard(coarse)
    ordered = lambda rows: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    around = shared.where("line <> centre").where(_near("bits", "centre_bits")).select(F.col("line").alias("a"), F.col("centre").alias("b"))
    tried = stored(ordered(around.unionAll(two).unionAll(fine_two)))
    texts = stored(texts_of(stored(shared.select("line").unionAll(tried.select(F.explode(F.array("a", "b")))).distinct())), **_TEXT)
    group = stored(components(_verified(tried, texts, similarity)))
    rows = _in_groups(shared.drop("centre", "centre_bits"), group)
    for turn in range(TURNS):
        many = rows.where(F.col("held") > MANY)
        if many.isEmpty():
            break
        drawn = Window.partitionBy("key").orderBy(F.xxhash64("line", F.lit(turn)), "line")
        placed = many.select("line", "bits", "group", *[F.first(c).over(drawn).alias(f"centre_{c}") for c in ("line", "bits", "group")])
        apart = placed.where("group <> centre_group").where(_near("bits", "centre_bits"))
        fresh = stored(ordered(apart.select(F.col("line").alias("a"), F.col("centre_line").alias("b"))).join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        tried, group = tried.unionAll(fresh), _merged(group, _verified(fresh, texts, similarity))
        rows = _in_groups(rows.drop("group"), group)
    # the key's largest line counts as its centre: of two components one at least is not the centre's
    centre = Window.partitionBy("key").orderBy(F.desc("n"), "line")
    others = rows.withColumn("main", F.first("group").over(centre)).where("group <> main")
    other = rows.select("key", F.col("line").alias("b"), F.col("bits").alias("other"), F.col("group").alias("elsewhere"))
    pairs = others.select("key", F.col("line").alias("a"), "bits", "group").join(other, "key").where("group <> elsewhere").where(_near("bits", "other"))
    found = _verified(ordered(pairs).join(tried, ["a", "b"], "left_anti"), texts, similarity)
    discard(texts)
    return _merged(group, found)


def _answers(docs: DataFrame, occurrences: DataFrame, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """name and kept (the place that stays) of every line that occurs, itself or in its group, more than once."""
    lines = occurrences.groupBy("name").agg(F.min(_place()).alias("first"), F.count("*").alias("n"), F.min("bits").alias("bits"))
    lines = stored(lines.select(F.monotonically_increasing_id().alias("line"), "name", "first", "n", "bits"))

    def texts_of(held: DataFrame) -> DataFrame:
        """The lines' texts, cut anew out of the documents that they stand in first."""
        wanted = stored(lines.join(held, "line", "left_semi").select("line", "name", "first", ((F.col("first") - F.pmod("first", F.lit(1 << 31))) / (1 << 31)).cast("long").alias("doc")))
        there = docs.withColumn("doc", _document(id_col)).join(wanted.select("doc").distinct(), "doc", "left_semi").drop("doc")
        found = _occurrences(there, id_col, text_col).withColumn("first", _place()).join(wanted.drop("doc"), "first").where(_name("norm") == F.col("name"))
        return found.select("line", "norm").dropDuplicates(["line"])

    group = line_groups(lines.select("line", "n", "bits"), texts_of, similarity)
    named = lines.select("line", "name", "first", "n").join(group, lines["line"] == group["node"], "left").where("n > 1 OR component IS NOT NULL")
    named = named.select("name", "first", "n", F.coalesce("component", "line").alias("group"))
    kept = named.groupBy("group").agg(F.min("first").alias("kept"))
    answers = stored(named.select("name", "group").join(kept, "group").select("name", "kept"))
    discard(lines)
    return answers


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, n_groups and kept_text: every text with one occurrence of each group of lines.

    Lines are split at line feeds and normalised (lower case, blanks as one space). Equal ones are
    one node; different ones are linked when the SimHash fingerprints of their sets of words differ in
    at most 3 bits and their edit similarity (1 less the edits over the longer length) is at least
    ``similarity``. Of each connected group the first occurrence, by document and line, stays as it
    is; n_groups counts the lines that stay. Blank lines always stay and belong to no group.

    A null text has no lines, an empty one a single blank line. A null identifier comes before all
    others; rows of one identifier count as one document, so a first line that several of them have at
    one place stays in each, and rows that repeat an identifier and text get the same answer. An
    empty table gives no rows. Other columns are not read.
    """
    found = fingerprints(_occurrences(docs, id_col, text_col)).select("doc", "key", "pos", _name("norm").alias("name"), "bits")
    occurrences = stored(found)
    answers = _answers(docs, occurrences, similarity, id_col, text_col)
    gone = occurrences.join(answers, "name").where(_place() != F.col("kept")).select("doc", "key", "pos")
    removed = stored(gone.groupBy("doc", "key").agg(F.collect_set("pos").alias("removed")))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), _document(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")
    )
    joined = rows.join(removed, ["doc", "key"], "left")
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))

    def without(x: Column) -> Column:
        """The lines between removed ones, so that each is looked at once."""
        starts = F.concat(F.array(F.lit(0)), F.transform(x["gone"], lambda r: r + 1))
        ends = F.concat(x["gone"], F.array(F.size(x["lines"])))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(x["lines"], s + 1, e - s))), "\n")

    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    filled = F.size(F.filter(lines, lambda x: x.rlike(r"\S"))).cast("long")
    kept = F.when(F.col("removed").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.transform(F.array(F.struct(lines.alias("lines"), F.array_sort("removed").alias("gone"))), without)[0])
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), n_removed.alias("n_removed"), (filled - n_removed).alias("n_groups"), kept.alias("kept_text"))


def line_report(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`dedup_lines`, with kept_sha256 in place of the kept text."""
    found = dedup_lines(docs, similarity, id_col, text_col)
    return found.select("doc_id", "n_lines", "n_removed", "n_groups", F.sha2("kept_text", 256).alias("kept_sha256"))

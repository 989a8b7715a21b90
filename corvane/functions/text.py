"""Text, path and address functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each language family, without the dot. Those with a grammar come first.
PARSED = {"rs": "source", "py": "source", "pyi": "source", "ts": "source", "mts": "source", "cts": "source", "tsx": "source", "md": "document", "markdown": "document"}
SOURCE = """bash c cc cjs cpp cs css cxx dart erl ex exs go h hh hpp hs htm html java js jsx kt kts lua m mjs mm php pl pm proto
ps1 psm1 r rb scala scss sh sql svelte swift vue zig zsh""".split()
DOCUMENT = "adoc mdx org rst txt".split()
CONFIG = "cfg conf csv env hcl ini json json5 jsonc lock plist properties tf tfvars toml tsv xml yaml yml".split()
LARGEST, LEAST = 2_000_000, 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[.]([A-Za-z0-9]+)$", 1))


def language_family(path: Column) -> Column:
    """source, document, config or unknown, by a path's extension in any case."""
    ext = extension(path)
    of = lambda family, rest: ext.isin(*[e for e, f in PARSED.items() if f == family], *rest)
    return F.when(of("source", SOURCE), "source").when(of("document", DOCUMENT), "document").when(of("config", CONFIG), "config").otherwise("unknown")


def skip_reason(family: Column, size: Column, largest: int = LARGEST, least: int = LEAST) -> Column:
    """Why a file is left out, or null; the first rule that holds."""
    return (
        F.when(family == "unknown", "unsupported-extension")
        .when(family == "config", "config-format")
        .when(size > largest, "too-large")
        .when(size < least, "too-small")
    )


def token_estimate(text: Column) -> Column:
    """Three bytes to a token, rounded up."""
    return F.ceil(F.octet_length(text) / 3.0).cast("long")


def snippet(text: Column, lines: int = 5) -> Column:
    """The first lines, without the empty one that a closing line feed leaves."""
    return F.array_join(F.slice(F.split(F.rtrim(text, F.lit("\n")), "\n"), 1, lines), "\n")


def first_line(text: Column, width: int) -> Column:
    return F.left(F.split(text, "\n")[0], F.lit(width))


def chunks(text: Column, window: int, overlap: int) -> Column:
    """Overlapping pieces of at most ``window`` characters; every text has one at least."""
    step = window - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / float(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(window)))


def conversation_address(address: Column) -> tuple[Column, Column]:
    """The conversation and the turn number of an address ``conv:<guid>#t<n>``; null number without one."""
    number = F.regexp_extract(address, "#t([0-9]+)$", 1)
    return F.regexp_extract(address, "^conv:([^#]+)", 1), F.when(number != "", number).cast("long")


def minted_prefix(identifier: Column) -> Column:
    """What stands before the dash and four hexadecimal digits of a minted id; null for other ids."""
    found = F.regexp_extract(identifier, "^([^-]+)-[0-9a-f]{4}$", 1)
    return F.when(found != "", found)


def repository_key(url: Column) -> Column:
    """host/path of a repository in any of its spellings: https, ssh, scp-like, with or without user, port, .git."""
    plain = F.regexp_replace(F.trim(url), r"^(?:[a-z+]+://)?(?:[^/@]*@)?", "")
    slashed = F.when(url.contains("://"), F.regexp_replace(plain, r"^([^/:]+):[0-9]+/", "$1/")).otherwise(F.regexp_replace(plain, r"^([^/:]+):", "$1/"))
    trimmed = F.regexp_replace(F.regexp_replace(slashed, "/+$", ""), r"\.git$", "")
    host = F.lower(F.substring_index(trimmed, "/", 1))
    return F.concat(host, F.regexp_replace(trimmed, "^[^/]+", ""))


def canonical_model(name: Column) -> Column:
    """A model's name without provider, date stamp and bracketed or tagged variants."""
    bare = F.lower(F.substring_index(F.trim(name), "/", -1))
    return F.regexp_replace(F.regexp_replace(bare, r"[\[@:].*$", ""), r"-20[0-9]{6}$", "")


def identifier_words(text: Column) -> Column:
    """Lower-case words of source code: split at anything but letters and digits, at camel humps, acronyms and digits."""
    spaced = F.regexp_replace(text, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", " ")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def scrub_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit("�"))


def head(text: Column, most: int = 512) -> Column:
    """struct(head, total_bytes, truncated): at most ``most`` bytes, cut between characters."""
    size, data = F.octet_length(text), F.encode(text, "utf-8")
    inside = lambda n: F.hex(F.substring(data, n + 1, 1)).between("80", "BF")  # noqa: E731  whether a cut after n bytes splits a character
    at = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    whole = F.when(size <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), at), "utf-8"))
    return F.struct(whole.alias("head"), size.alias("total_bytes"), (size > most).alias("truncated"))


def canonical_tag(tag: Column) -> Column:
    """A tag in lower case, with other punctuation and ordinals as blanks and its last word singular; null if nothing is left."""
    plain = F.regexp_replace(F.lower(tag), "[`'\"]", "")
    plain = F.regexp_replace(plain, r"#[0-9]+\b", " ")
    plain = F.regexp_replace(plain, r"[^A-Za-z0-9_\s.+#/-]", " ")
    plain = F.when(plain.rlike(r"[A-Za-z0-9_][./][A-Za-z0-9_]"), plain).otherwise(F.translate(plain, "-_", "  "))
    plain = F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"\.+$", "")
    last = F.substring_index(plain, " ", -1)
    single = (
        F.when((F.length(last) <= 3) | ~last.rlike("^[a-z]+$") | last.rlike("(ss|us|is|ics|ous)$"), last)
        .when(last.endswith("ies"), F.regexp_replace(last, "ies$", "y"))
        .when(last.rlike("(sses|shes|ches|xes|zzes)$"), F.regexp_replace(last, "es$", ""))
        .otherwise(F.regexp_replace(last, "s$", ""))
    )
    done = F.concat(F.left(plain, F.length(plain) - F.length(last)), single)
    return F.when((F.length(plain) >= 2) & (F.length(plain) <= 48) & plain.rlike("[A-Za-z]"), done)

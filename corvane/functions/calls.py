"""What a turn says: searches, retrieval commands and their answers, written files, messages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import head

# The verbs that retrieve, the tools that write files, and the keys that name a file, first one first.
VERBS = ("search", "get", "ask", "refs", "tree", "docs", "agents-start-here")
WRITERS = ("write", "edit", "create", "str_replace", "apply_patch", "multiedit")
PATH_KEYS = ("file_path", "path", "filePath")
ENVELOPE_BYTES = 256
KEY_CHARS, LEAST_KEY_CHARS = 40, 12


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def prompt_search(body: Column, command: str) -> Column:
    """Whether a text is the command with one quoted string on one line, and nothing else."""
    return body.rlike(rf"""^\s*{re.escape(command)}[^\S\n]+("[^"\n]*"|'[^'\n]*'|“[^“”\n]*”)\s*$""")


def has_prose(body: Column, heads: Column) -> Column:
    """Whether a body says more than the head of one of the tool results (an array of texts) that came with it."""
    said = _trim(body)
    echoes = lambda h: (_trim(h) != "") & (F.startswith(_trim(h), said) | F.startswith(said, _trim(h)))
    return (said != "") & ~F.coalesce(F.exists(heads, echoes), F.lit(False))


def retrieval_envelope(text: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    """Whether a result starts as the JSON answer of a retrieval verb, by its first bytes."""
    start = head(F.regexp_replace(text, r"^\s+", ""), ENVELOPE_BYTES)["head"]
    value = F.regexp_extract(start, r'(?s)"command"(.*)', 1)
    return start.startswith("{") & start.contains('"ok"') & value.rlike(rf'^\s*:\s*"{_any(verbs)}("|$)')


# What stands before a command that a shell runs, and before one in a JSON value or list.
SEPARATORS = (";", "|", "(", "{", "!", "[", "&&", ':"', ': "', '["', "['", '("', "('")
KEYWORDS = ("command", "do", "else", "exec", "nohup", "sudo", "then", "time")


def _line_runs(command: str, verbs: tuple[str, ...]) -> str:
    """A pattern for one line: start or separator, assignments, path and command, then options (or list items) up to a verb."""
    starts = rf"(?:^|{_any(SEPARATORS)}|\b{_any(KEYWORDS)}\s)"
    assigned = r"""(?:["']?[A-Za-z_]\w*=[^\s"']*\s+)*"""
    path = r"""(?:[^\s"'\[(;|&]*/)?"""
    closing = r"""["'\\)\]]*"""
    option = rf"""{closing}(?:-[^\s,]*)?[\s,]+"""
    return rf"""{starts}\s*{assigned}{path}{re.escape(command)}(?=[\s"'\\,])(?:{option})*{closing}{_any(verbs)}{closing}(?:[\s,]|$)"""


def _heredoc(line: Column) -> Column:
    """The word that ends the heredoc which a line writes to a file, else empty.

    Such a line calls ``tee``, or ``cat`` with its output sent on; a heredoc for any other command is read by it and may be code.
    """
    words = F.split(_trim(line), r"\s+")
    writes = F.array_contains(words, "tee") | (F.array_contains(words, "cat") & line.contains(">"))
    mark = F.translate(F.substring_index(line, "<<", -1), "\"'-", "   ")
    return F.when(writes & line.contains("<<"), F.regexp_extract(mark, r"^\s*(\w+)", 1)).otherwise("")


def runs_retrieval(text: Column, command: str, verbs: tuple[str, ...] = VERBS) -> Column:
    """Whether shell text, possibly escaped as JSON, runs ``command`` with a retrieval verb.

    The command counts where a shell would run it: at a line's start, after a separator or keyword,
    as a JSON value or list head, after assignments, with or without a path; never in a heredoc
    that ``cat`` or ``tee`` writes to a file. Null for a null text.
    """
    plain = F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit('\\"'), F.lit('"'))
    runs = _line_runs(command, verbs)
    start = F.struct(F.lit("").alias("until"), F.lit(False).alias("found"))

    def step(state: Column, line: Column) -> Column:
        inside = state["until"] != ""
        until = F.when(~inside, _heredoc(line)).when(_trim(line) == state["until"], "").otherwise(state["until"])
        return F.struct(until.alias("until"), (state["found"] | (~inside & line.rlike(runs))).alias("found"))

    return F.aggregate(F.split(plain, "\n"), start, step, lambda s: s["found"])


def writes_file(tool: Column) -> Column:
    """Whether a tool, by the last part of its name in any case, is one that writes files."""
    name = F.lower(F.regexp_extract(tool, r"([^./:]*)$", 1))
    return name.rlike(rf"^{_any(WRITERS)}($|[^a-z0-9])")


def written_path(text: Column) -> Column:
    """The file that the input of a writing tool names, never what is written: a JSON key's value, a
    bracketed target of a JSON ``input``, or a plain text's first line; empty if there is none."""
    value = lambda key: F.regexp_extract(text, rf'(?s)"{key}":(.*)', 1)  # noqa: E731  what follows the first such key
    named = [F.regexp_extract(value(k), r'^\s*"([^"\\]*)"', 1) for k in PATH_KEYS]
    target = F.regexp_replace(F.regexp_extract(value("input"), r'^\s*"\[([^\]\\]*)[\]\\]', 1), "#[^#]*$", "")
    found = F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in [*named, target]], F.lit(""))
    return F.when(text.rlike(r"^\s*\{"), found).otherwise(_trim(F.split(text, "\n")[0]))


# Fixed value: the shape of a seat's name, with or without its host.
SEAT = "[a-z]+-[a-z0-9-]+"
_QUOTES = "\"'"


def _filled(text: Column) -> Column:
    """The text, or null if it is empty."""
    return F.when(text != "", text)


def _once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _after(text: Column, mark: str) -> Column:
    """What follows the first ``mark``, or null."""
    return _once(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.substr(t, F.locate(mark, t) + len(mark))))


def _words(text: Column) -> Column:
    """Words of text that may be escaped: blanks and their escapes part words, quotes and backslashes are left out."""
    blank = text
    for escape in ("\\n", "\\t", "\\r"):
        blank = F.replace(blank, F.lit(escape), F.lit(" "))
    return F.filter(F.split(F.translate(blank, _QUOTES + "\\", ""), r"\s+"), lambda w: w != "")


def _from(words: Column, fits) -> Column:
    """The words from the first one on that ``fits`` (word, the one before it, which is empty for the first)."""
    none = F.array().cast("array<string>")

    def rest(ws: Column) -> Column:
        flags = F.transform(ws, lambda w, i: fits(w, F.when(i > 0, F.get(ws, i - 1)).otherwise("")))
        return _once(F.array_position(flags, True).cast("int"), lambda at: F.when(at > 0, F.slice(ws, at, F.size(ws))).otherwise(none))

    return _once(words, rest)


def _is_option(word: Column) -> Column:
    return word.startswith("-")


def _value(text: Column, key: str) -> Column:
    """The JSON string of ``key``, still escaped and with all that follows it, or null; keys and quotes may be escaped themselves."""
    tail = F.ltrim(_after(F.replace(text, F.lit('\\"'), F.lit('"')), f'"{key}"'))
    opened = _once(tail, lambda t: F.when(t.startswith(":"), F.ltrim(F.substr(t, F.lit(2)))))
    return _once(opened, lambda o: F.when(o.startswith('"'), F.substr(o, F.lit(2))))


def sender(body: Column, tool: str) -> Column:
    """The seat in a delivered message's envelope ``[<tool> from <seat>]``."""
    inside = _once(_after(body, f"[{tool} from "), lambda t: F.when(F.contains(t, F.lit("]")), F.substring_index(t, "]", 1)))
    return _once(inside, lambda seat: F.when(seat.rlike(rf"^{SEAT}(@[A-Za-z0-9.-]+)?$"), seat))


def _sent(text: Column, tool: str) -> Column:
    """The words of a send on a command line from its seat on: options between the call and the seat are left out."""
    tail = _once(_after(text, f"{tool} send"), lambda t: F.when(t.rlike(r"^[\s\\]"), t))
    return _from(_words(tail), lambda w, _: ~_is_option(w))


def _is_call(text: Column, tool: str) -> Column:
    return text.startswith(f"[tool-call {tool}_send]")


def target(text: Column, tool: str) -> Column:
    """The seat that a send call names: its JSON key ``to``, else the first word after the options of ``<tool> send``."""
    named = F.when(_is_call(text, tool), F.regexp_extract(_value(text, "to"), f"^{SEAT}", 0))
    return F.coalesce(_once(named, _filled), _once(F.regexp_extract(F.get(_sent(text, tool), F.lit(0)), f"^{SEAT}", 0), _filled))


def _says(word: Column, before: Column) -> Column:
    """Whether a word after the seat is the message, not an option, nor what opens a heredoc or the ``cat`` that reads one."""
    opens = _is_option(word) | word.startswith("<<") | word.isin("$(", "$(cat")
    return ~opens & ~before.isin("<<", "<<-") & ~((before == "$(") & (word == "cat"))


def message_key(text: Column, tool: str, sent: bool) -> Column:
    """The first 40 letters and digits of a message's body, in lower case: equal for a delivered message and the call that
    sent it, whatever the quoting. Null without a body of at least 12."""
    if sent:
        line = _once(_sent(text, tool), lambda ws: F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(1))))
        body = F.coalesce(F.when(_is_call(text, tool), _words(_value(text, "message"))), _from(line, _says))
    else:
        body = _words(_after(_after(text, f"[{tool} from "), "]"))
    key = F.left(F.regexp_replace(F.lower(F.array_join(body, "")), "[^a-z0-9]+", ""), F.lit(KEY_CHARS))
    return _once(key, lambda k: F.when(F.length(k) >= LEAST_KEY_CHARS, k))


# What a grammar's node names hold if they stand for a callable, container or section, and how declarations end.
CALLABLE = ("function", "method", "constructor", "subroutine", "procedure")
CONTAINER = ("class", "struct", "interface", "enum", "trait", "type", "record", "protocol", "impl", "union", "mod", "namespace")
SECTION = ("heading", "section")
ENDINGS = ("_item", "_declaration", "_definition", "_signature", "_spec")
BARE = ("method", "class", "module", "function", "internal_module", "atx_heading", "setext_heading")


def element_kind(node: Column) -> Column:
    """function, container or section for the node of a grammar that declares one; null for other nodes."""
    kind = F.when(node.rlike(_any(CALLABLE)), "function").when(node.rlike(_any(CONTAINER)), "container").when(node.rlike(_any(SECTION)), "section")
    declares = node.isin(*BARE) | node.rlike(_any(ENDINGS) + "$") | ((kind == "container") & node.endswith("_specifier"))
    return F.when(declares, kind)


def row_location(location: Column) -> Column:
    """struct(section, parts, index) of ``$.sections[name].value[part]...[index]``; null for anything else."""
    tail = F.regexp_extract(location, r"^\$\.sections\[[^\]]*\]\.value((?:\[[^\]]*\])+)", 1)
    parts = F.regexp_extract_all(tail, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    last = F.try_element_at(parts, F.lit(-1))
    index = F.when(last.rlike("^[0-9]+$"), last.try_cast("long"))
    section = F.regexp_extract(location, r"^\$\.sections\[([^\]]*)\]", 1)
    return F.when(index.isNotNull(), F.struct(section.alias("section"), F.slice(parts, F.lit(1), F.size(parts) - 1).alias("parts"), index.alias("index")))

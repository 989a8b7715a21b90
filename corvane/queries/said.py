"""What turns say: searches, retrieval calls and answers, prose, written files and messages around the conversations' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import calls
from corvane.model import Tables, with_views
from corvane.queries import query

# A turn's first line without anything but letters and blanks stands where a tool would be given words.
_WORDS = "words AS (SELECT conv_id, turn_no, body, regexp_replace(split_part(body, chr(10), 1), '[^A-Za-z ]', '', 'g') AS fl FROM turns)"


def _words(t: Tables) -> DataFrame:
    return t.turns.select("conv_id", "turn_no", "body", F.regexp_replace(F.split("body", "\n")[0], "[^A-Za-z ]", "").alias("fl"))


def _cases(number: Column, *texts: Column) -> Column:
    """The text whose place is the remainder of a number."""
    found = texts[-1]
    for i in range(len(texts) - 2, -1, -1):
        found = F.when(number % len(texts) == i, texts[i]).otherwise(found)
    return found


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


@query(
    with_views(
        f"""{_WORDS}, x AS (SELECT *, CASE turn_no % 4 WHEN 0 THEN 'find "' || fl || '"' WHEN 1 THEN ' find ''' || fl || ''' ' || chr(10) WHEN 2 THEN 'then find "' || fl || '"' ELSE body END AS said FROM words)
        SELECT conv_id, turn_no, regexp_full_match(said, '\\s*find[ \\t]+("[^"\\n]*"|''[^''\\n]*'')\\s*') AS searches FROM x""",
        "turns",
    )
)
def prompt_searches(t: Tables) -> DataFrame:
    fl = F.col("fl")
    said = _cases(F.col("turn_no"), _said('find "', fl, '"'), _said(" find '", fl, "' \n"), _said('then find "', fl, '"'), F.col("body"))
    return _words(t).select("conv_id", "turn_no", calls.prompt_search(said, "find").alias("searches"))


@query(
    with_views(
        f"""{_WORDS}, x AS (SELECT *, CASE turn_no % 3 WHEN 0 THEN '  ' || left(body, 30) WHEN 1 THEN body ELSE chr(10) END AS said, CASE WHEN turn_no % 2 = 0 THEN left(body, 40) ELSE '' END AS head FROM words),
        y AS (SELECT *, regexp_replace(said, '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(head, '^\\s+|\\s+$', '', 'g') AS h FROM x)
        SELECT conv_id, turn_no, s <> '' AND NOT (h <> '' AND (starts_with(h, s) OR starts_with(s, h))) AS prose FROM y""",
        "turns",
    )
)
def prose_turns(t: Tables) -> DataFrame:
    body = F.col("body")
    said = _cases(F.col("turn_no"), _said("  ", F.left(body, F.lit(30))), body, F.lit("\n"))
    heads = F.array(F.when(F.col("turn_no") % 2 == 0, F.left(body, F.lit(40))).otherwise(""), F.lit("another tool's result"))
    return _words(t).select("conv_id", "turn_no", calls.has_prose(said, heads).alias("prose"))


@query(
    with_views(
        f"""{_WORDS}, x AS (SELECT *, CASE turn_no % 5 WHEN 0 THEN '{{"ok":true,"command":"search","body":"' || fl || '"}}' WHEN 1 THEN '{{"ok":true,"command":"scan","body":"' || fl || '"}}'
            WHEN 2 THEN '  {{"command" : "get", "body": "' || left(fl, 50) || '", "ok": 1}}' WHEN 3 THEN '{{"ok":1,"body":"' || fl || '","command":"ask"}}' ELSE body END AS said FROM words)
        SELECT conv_id, turn_no, starts_with(h, '{{') AND contains(h, '"ok"') AND regexp_matches(h, '"command"\\s*:\\s*"(search|get|ask|refs|tree|docs|agents-start-here)("|$)') AS answers FROM (SELECT *, left(ltrim(said), 256) AS h FROM x)""",
        "turns",
    )
)
def retrieval_answers(t: Tables) -> DataFrame:
    fl = F.col("fl")
    answer = lambda verb: _said(f'{{"ok":true,"command":"{verb}","body":"', fl, '"}')
    said = _cases(F.col("turn_no"), answer("search"), answer("scan"), _said('  {"command" : "get", "body": "', F.left(fl, F.lit(50)), '", "ok": 1}'), _said('{"ok":1,"body":"', fl, '","command":"ask"}'), F.col("body"))
    return _words(t).select("conv_id", "turn_no", calls.retrieval_envelope(said).alias("answers"))


@query(
    with_views(
        f"""{_WORDS}, x AS (SELECT *, string_split(CASE turn_no % 6 WHEN 0 THEN 'cd x && find --json search ' || fl WHEN 1 THEN 'cat > notes <<EOF' || chr(10) || 'find search ' || fl || chr(10) || 'EOF' WHEN 2 THEN 'echo find search ' || fl
            WHEN 3 THEN 'A=1 ./bin/find get ' || fl WHEN 4 THEN '{{"command":"find ask ' || fl || '"}}' ELSE body || chr(10) || 'sudo find tree' END, chr(10)) AS lines FROM words)
        SELECT conv_id, turn_no, NOT regexp_matches(lines[1], '^cat >.*<<') AND len(list_filter(lines, lambda l: regexp_matches(l, '(^|&& |"command":"|sudo )(A=1 )?(\\./bin/)?find (--json )?(search|get|ask|tree)( |"|$)'))) > 0 AS runs FROM x""",
        "turns",
    )
)
def retrieval_calls(t: Tables) -> DataFrame:
    fl = F.col("fl")
    said = _cases(
        F.col("turn_no"), _said("cd x && find --json search ", fl), _said("cat > notes <<EOF\nfind search ", fl, "\nEOF"), _said("echo find search ", fl), _said("A=1 ./bin/find get ", fl),
        _said('{"command":"find ask ', fl, '"}'), _said(F.col("body"), "\nsudo find tree"),
    )
    return _words(t).select("conv_id", "turn_no", calls.runs_retrieval(said, "find").alias("runs"))


@query(
    with_views(
        f"""{_WORDS} SELECT conv_id, turn_no, CASE turn_no % 4 WHEN 0 THEN trim(fl) WHEN 1 THEN trim(fl) WHEN 2 THEN CASE WHEN trim(fl) = '' THEN 'b' ELSE trim(fl) END ELSE '' END AS path, turn_no % 2 = 0 AS writes FROM words""",
        "turns",
    )
)
def written_files(t: Tables) -> DataFrame:
    fl = F.col("fl")
    given = _cases(F.col("turn_no"), _said('{"file_path":"', fl, '","content":"x"}'), _said(" ", fl, "\n", F.col("body")), _said('{"path": "', fl, '", "filePath": "b"}'), F.lit('{"content":"x"}'))
    tool = F.when(F.col("turn_no") % 2 == 0, F.concat(F.lit("fs."), F.lit("Write"))).otherwise("fs.read")
    return _words(t).select("conv_id", "turn_no", calls.written_path(given).alias("path"), calls.writes_file(tool).alias("writes"))


_KEY = "left(regexp_replace(lower(body), '[^a-z0-9]+', '', 'g'), 40)"


@query(
    with_views(
        f"""{_WORDS} SELECT conv_id, turn_no, CASE WHEN turn_no % 3 > 0 THEN 'ab-c' || conv_id || CASE WHEN turn_no % 3 = 2 THEN '@host.x' ELSE '' END END AS sender,
        CASE WHEN turn_no % 3 > 0 AND length({_KEY}) >= 12 THEN {_KEY} END AS key FROM words""",
        "turns",
    )
)
def delivered_messages(t: Tables) -> DataFrame:
    seat = F.concat(F.lit("ab-c"), "conv_id")
    said = _cases(F.col("turn_no"), F.col("body"), _said("[post from ", seat, "] ", F.col("body")), _said("[post from ", seat, "@host.x]\n", F.col("body")))
    return _words(t).select("conv_id", "turn_no", calls.sender(said, "post").alias("sender"), calls.message_key(said, "post", False).alias("key"))


@query(
    with_views(
        f"""{_WORDS} SELECT conv_id, turn_no, CASE WHEN turn_no % 4 < 3 THEN 'ab-d' || conv_id END AS target, CASE WHEN turn_no % 4 < 3 AND length({_KEY.replace('body', 'fl')}) >= 12 THEN {_KEY.replace('body', 'fl')} END AS key FROM words""",
        "turns",
    )
)
def sent_messages(t: Tables) -> DataFrame:
    seat, fl = F.concat(F.lit("ab-d"), "conv_id"), F.col("fl")
    said = _cases(
        F.col("turn_no"), _said("post send --now ", seat, ' "', fl, '"'), _said('[tool-call post_send]\n{"to":"', seat, '","message":"', fl, '"}'), _said("cd x; post send '", seat, "' - <<'END'\n", fl), F.col("body")
    )
    return _words(t).select("conv_id", "turn_no", calls.target(said, "post").alias("target"), calls.message_key(said, "post", True).alias("key"))


_NODES = ("function_item", "struct_specifier", "function_specifier", "atx_heading", "mod_item", "identifier", "class", "method_signature", "struct_expression")


@query(
    f"""WITH n AS (SELECT event_id, ({list(_NODES)})[1 + event_id % {len(_NODES)}] AS node FROM events)
    SELECT event_id, node, CASE node WHEN 'function_item' THEN 'function' WHEN 'struct_specifier' THEN 'container' WHEN 'atx_heading' THEN 'section' WHEN 'mod_item' THEN 'container' WHEN 'class' THEN 'container' WHEN 'method_signature' THEN 'function' END AS kind FROM n"""
)
def node_kinds(t: Tables) -> DataFrame:
    node = F.element_at(F.array(*map(F.lit, _NODES)), (F.col("event_id") % len(_NODES) + 1).cast("int"))
    return t.events.select("event_id", node.alias("node"), calls.element_kind(node).alias("kind"))

"""Hand-checked texts of turns, grammar nodes and locations."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import calls


def apply(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r.v for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_prompt_search(spark):
    texts = ['find "a b"', " find 'x' \n", "find “x”", 'fix it, find "x"', 'find"x"', 'find "a" "b"', 'find "a\nb"', "", None]
    assert apply(spark, lambda t: calls.prompt_search(t, "find"), texts) == [True, True, True, False, False, False, False, False, None]


@pytest.mark.parametrize(
    ("body", "heads", "prose"),
    [("done", [], True), ("  ", [], False), ("out", ["output of it"], False), ("output of it and more", [" output of it "], False), ("mine", ["other", ""], True), ("mine", None, True)],
)
def test_has_prose(spark, body, heads, prose):
    row = spark.createDataFrame([(body, heads)], "b string, h array<string>").select(calls.has_prose(F.col("b"), F.col("h"))).first()
    assert row[0] is prose


def test_retrieval_envelope(spark):
    texts = ['{"ok":true,"command":"search"}', ' {"command" : "get", "ok":1', '{"ok":true,"command":"scan"}', '{"command":"search"}', '["ok","command":"search"]', '{"ok":1,' + " " * 300 + '"command":"search"}']
    assert apply(spark, calls.retrieval_envelope, texts) == [True, True, False, False, False, False]


RUNS = [
    ("find search x", True),
    ("cd a && find --json search x", True),
    ("A=1 B=2 ./bin/find get y", True),
    ('{"command":"find ask why"}', True),
    ('{"command":"A=b find ask why"}', True),
    ('subprocess.run(["find","search",q])', True),
    ("if x; then find tree src; fi", True),
    ("find tree; ls", False),
    ("ls\\nfind docs", True),
    ("sudo find refs z", True),
    ("echo find search x", False),
    ("find scan", False),
    ("refind search", False),
    ("find2 search", False),
    ("cat > a.md <<EOF\nfind search x\nEOF", False),
    ("cat > a.md <<'EOF'\nwords\nEOF\nfind search x", True),
    ("python3 - <<EOF\nfind search x\nEOF", True),
    ("", False),
    (None, None),
]


def test_runs_retrieval(spark):
    assert apply(spark, lambda t: calls.runs_retrieval(t, "find"), [t for t, _ in RUNS]) == [v for _, v in RUNS]


def test_written_files(spark):
    assert apply(spark, calls.writes_file, ["Write", "fs.write", "str_replace_editor", "writer", "Read", "a/MultiEdit"]) == [True, True, True, False, False, True]
    inputs = ['{"file_path":"a.py","content":"x"}', '{"content":"x", "path": "b"}', '{"input":"[c/d.rs#A1]\\nbody"}', '{"content":"x"}', '{"path":"a\\u0041"}', " e.txt \nbody", ""]
    assert apply(spark, calls.written_path, inputs) == ["a.py", "b", "c/d.rs", "", "", "e.txt", ""]


def test_messages(spark):
    assert apply(spark, lambda t: calls.sender(t, "post"), ["[post from ab-c1@host.x] hi", "post from ab-c", None]) == ["ab-c1@host.x", None, None]
    sends = ['[tool-call post_send]\n{"to":"ab-red","message":"Look at the Parser, please"}', "post send --now ab-red \"Look at the\\nparser, please\"", "post send ab-red ack", "other"]
    assert apply(spark, lambda t: calls.target(t, "post"), sends) == ["ab-red", "ab-red", "ab-red", None]
    assert apply(spark, lambda t: calls.message_key(t, "post", True), sends) == ["lookattheparserplease", "lookattheparserplease", None, None]
    assert apply(spark, lambda t: calls.message_key(t, "post", False), ["[post from ab-x]\nlook at the parser, please", "none"]) == ["lookattheparserplease", None]


SENDS = [
    ("post send ab-red - <<'EOF'\nlook at the parser please\nEOF", "ab-red", "lookattheparserpleaseeof"),
    ("post send --urgent 'ab-red' -- \"$(cat <<EOF\nlook at the parser please", "ab-red", "lookattheparserplease"),
    ("post send ab-red $( cat << EOF\nlook at the parser please", "ab-red", "lookattheparserplease"),
    ('cd x && post send ab-red@host \\"It\\\\n is - really - <b>done</b>!\\"', "ab-red", "itisreallybdoneb"),
    ('[tool-call post_send]\n{\\"message\\": \\"Look at the parser, please\\", \\"to\\" : \\"ab-red\\"}', "ab-red", "lookattheparserpleasetoabred"),
    ("post send --now", None, None),
    ("post sendab-red", None, None),
    ("", None, None),
]


@pytest.mark.parametrize(("text", "seat", "key"), SENDS)
def test_sends(spark, text, seat, key):
    row = spark.createDataFrame([(text,)], "t string").select(calls.target(F.col("t"), "post"), calls.message_key(F.col("t"), "post", True)).first()
    assert tuple(row) == (seat, key)


def test_element_kind(spark):
    nodes = ["function_item", "struct_expression", "constructor_declaration", "struct_specifier", "function_specifier", "atx_heading", "mod_item", "identifier", None]
    assert apply(spark, calls.element_kind, nodes) == ["function", None, "function", "container", None, "section", "container", None, None]


def test_row_location(spark):
    got = apply(spark, calls.row_location, ["$.sections[a b].value[x][3]", "$.sections[a].value[0]", "$.sections[a].value", "$.sections[a].value[x]", "rows[1]", None])
    assert [g and (g["section"], list(g["parts"]), g["index"]) for g in got] == [("a b", ["x"], 3), ("a", [], 0), None, None, None, None]

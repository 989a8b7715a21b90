"""Structured documents and trees on hand-made cases."""

import json

from corvane.operators import structured, trees

DOC = {
    "dd": {"schema": "plan/1", "sweep_exclude": True},
    "sections": [
        {"name": "meta", "value": {"title": "A plan"}},
        {"name": "tasks", "value": {"z": [{"id": "t2", "what": "sweep", "who": "x"}], "a": {"deep": [[[{"id": "t1", "state": "open", "what": "cook", "n": 3, "kids": [{"id": "no"}]}]]]}, "id": 7}},
        {"name": "notes", "value": "plain\nwords"},
        {"name": "empty", "value": None},
        {"value": [{"id": "nameless"}]},
        {"name": "list", "value": [{"id": "l1"}, {"id": None, "in": {"id": "l2"}}, 5]},
    ],
}


def docs(spark, *texts):
    return structured.parsed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_rows_at_any_depth(spark):
    deep = {"id": "bottom"}
    for _ in range(12):
        deep = {"k": [deep]}
    given = docs(spark, json.dumps(DOC), json.dumps({"sections": [{"name": "s", "value": deep}]}), "{", None, "[]", '{"sections": {}}')
    got = {(r.doc_id, tuple(r.trail)): r for r in structured.rows(given).collect()}
    assert sorted(k for k in got if k[0] == 0) == [(0, ("list", "in", "l2")), (0, ("list", "l1")), (0, ("tasks", "a", "deep", "t1")), (0, ("tasks", "z", "t2"))]
    first = got[0, ("tasks", "a", "deep", "t1")]
    assert (first.schema, first.sweep_excluded, first.title, first.state, first.sibling_order) == ("plan/1", True, "A plan", "open", 0)
    assert first.text == "tasks / a / deep\nwhat: cook" and first.basis == "fallback"
    assert got[0, ("tasks", "z", "t2")].sibling_order == 1 and got[0, ("list", "l1")].text == "list\n"
    (bottom,) = [k for k in got if k[0] == 1]
    assert bottom[1] == ("s", *["k"] * 12, "bottom")
    assert sorted(r.doc_id for r in structured.unparseable(given).collect()) == [2, 3]


def test_declared_fields(spark):
    declared = {"tasks": structured.Fields(prose=("what", "missing"), context=("who", "n"))}
    got = {r.trail[-1]: (r.text, r.basis) for r in structured.rows(docs(spark, json.dumps(DOC)), declared).collect()}
    assert got["t2"] == ("tasks / z\nwhat: sweep\ncontext who: x", "schema")
    assert got["t1"] == ("tasks / a / deep\nwhat: cook", "schema") and got["l1"] == ("list", "schema")


def test_sections_without_rows(spark):
    given = docs(spark, json.dumps(DOC))
    got = {r.section: r.text for r in structured.section_texts(given, structured.rows(given)).collect()}
    assert got == {"meta": 'meta\n{"title":"A plan"}', "notes": "notes\nplain\nwords", "empty": "empty\nnull"}


def test_trees(spark):
    chain = [(i, i - 1 if i else None, 0) for i in range(300)]
    fan = [(1000, None, 0), (1001, 1000, 1), (1002, 1000, 0), (1003, 1002, 5), (1004, 1000, 0)]
    lost = [(2000, 2001, 0), (2001, 2000, 0), (2002, 9999, 0), (2003, 2002, 0), (2004, 2004, 0)]
    nodes = spark.createDataFrame(chain + fan + lost, "id long, parent long, sibling_order int")
    got = {r.id: r for r in trees.assembled(nodes).collect()}
    assert all(got[i].depth == i and got[i].root == 0 for i in range(300))
    walk = sorted((r for r in got.values() if r.root == 1000), key=lambda r: [tuple(p) for p in r.place])
    assert [r.id for r in walk] == [1000, 1002, 1003, 1004, 1001]
    assert sorted(r.id for r in trees.loose(nodes, trees.assembled(nodes)).collect()) == [2000, 2001, 2002, 2003, 2004]
    assert trees.assembled(nodes.limit(0)).count() == 0


def test_levels_are_walked_in_one_pass(spark, monkeypatch):
    """Only what lies deeper than one pass reaches is stored and walked again."""
    stored, kept = [], structured.scratch.kept
    monkeypatch.setattr(structured.scratch, "kept", lambda df: stored.append(kept(df)) or stored[-1])
    given = docs(spark, json.dumps(DOC))
    found = structured.rows(given).select("doc_id", "section").collect()
    assert len(stored) == 1
    assert sorted(structured.holders(given).collect()) == sorted(found)
    deep = {"id": "bottom"}
    for _ in range(structured.LEVELS):
        deep = {"k": [deep]}
    (row,) = structured.rows(docs(spark, json.dumps({"sections": [{"name": "s", "value": [[], 1, {"z": 2}, deep]}]}))).collect()
    assert row.trail == ["s", *["k"] * structured.LEVELS, "bottom"] and row.sibling_order == 0

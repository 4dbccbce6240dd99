import pytest

from folioquarry.functions import notation as N
from folioquarry.operators import resolve as R


def test_roman():
    assert [N.roman(N.to_roman(n)) for n in range(1, 400)] == list(range(1, 400))


@pytest.mark.parametrize(("line", "style", "start"), [("- x", "bullet", None), ("3. x", "decimal", 3), ("(iv) x", "lower_roman", 4), ("B) x", "upper_alpha", 2), ("c. x", "lower_roman", 100), ("a. x", "lower_alpha", 1)])
def test_markers(line, style, start):
    m = N.list_marker(line)
    assert (m.style, m.start, m.body) == (style, start, "x")


def test_no_markers():
    assert N.list_marker("aa. x") is None and N.list_marker("text") is None and N.list_marker("1.x") is None


def test_phrases():
    split = lambda t: ["章", "の", "「", "管理", "」", "と", "自動化"]
    assert N.phrases("章の「管理」と自動化", split) == ["章の", "「管理」と", "自動化"]
    assert N.phrases("章の管理") == ["章の管理"] and N.phrases("x", lambda t: ["y"]) == ["x"]


def test_lines():
    assert N.merge_lines("これは途\n中です。\n次の文\n# 題\ninter-\nesting") == "これは途中です。\n次の文\n# 題\ninter-esting"


def test_html():
    assert N.replace_html('<a href="x">x</a><code>x</code> x', [N.Rule("x", "y")]) == '<a href="x">y</a><code>x</code> y'
    assert N.replace_html("<b>", [N.Rule("b", "i", "all")]) == "<i>"
    assert N.line_blocks('<span class="a">x\ny</span>z') == ['<span class="a">x</span>', '<span class="a">y</span>z']
    assert N.emoji("a😀b") == [(1, "1f600")] and N.deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3, "c": None}}) == {"a": {"b": 3, "c": 2}}


def test_tokens(spark):
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "basename string")
    catalog, files = names("01-intro", "02-history", "90-notes"), names("01-intro", "03-extra", "04", "05-same", "06-same")
    tokens = R.normalise(["1", "contents/02-history.md", "5-3", "notes", "same", "7", "7-new", "///", "!!"])
    got = {r["token"]: (r["basename"], r["label"]) for r in R.resolve_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), catalog, files).collect()}
    assert got == {"1": ("01-intro", "CATALOG"), "02-history": ("02-history", "CATALOG"), "3": ("03-extra", "UNCATALOGED"), "4": ("04", "UNCATALOGED"), "5": ("05-same", "UNCATALOGED"), "notes": ("90-notes", "CATALOG"), "same": (None, "INVALID"), "7": ("7", "NEW"), "7-new": ("7-new", "NEW"), "!!": (None, "INVALID")}
    shown = {r["basename"]: r["display"] for r in R.display_numbers(catalog).collect()}
    assert shown == {"01-intro": "1", "02-history": "2", "90-notes": "A"}

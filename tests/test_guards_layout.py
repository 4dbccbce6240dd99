import pytest
from pyspark.sql import functions as F

from folioquarry.operators import guards as G
from folioquarry.operators import indexing as I
from folioquarry.operators import layout as L
from folioquarry.sources import records as R


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_edits_take_the_longest_from_the_left():
    rules = [("ab", "1"), ("abc", "2"), ("cd", "3"), ("d", "4")]
    assert [(a, z, p) for a, z, p, _ in G.edits("abcd ab", rules)] == [(0, 3, "2"), (3, 4, "4"), (5, 7, "1")]
    assert [p for _, _, p, _ in G.edits("abcd ab", rules, ["ab."])] == ["1", "3", "1"]


def test_anchors_align_in_order():
    assert G.aligned(["b ", "x", "a", "b"], ["a", " b", "a", "b", "a"]) == [1, None, 2, 3] and G.aligned([], ["a"]) == []


def test_library_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([("a", "x"), ("b", None)], "term string, reading string")
    G.write_library(terms, str(tmp_path / "lib"))
    assert sorted(map(tuple, G.read_library(spark, str(tmp_path / "lib"), "term string, reading string").collect()), key=str) == [("a", "x"), ("b", None)]
    terms.withColumn("version", F.lit(9)).write.json(str(tmp_path / "odd"))
    with pytest.raises(ValueError):
        G.read_library(spark, str(tmp_path / "odd"), "term string, reading string")


def test_token_suggestions(spark):
    catalog = spark.createDataFrame([("01-start",), ("02-middle",), ("10-end",)], "basename string")
    asked = spark.createDataFrame([("01-strat",), ("02-something-else",), ("77-nothing-like-it",)], "token string")
    got = {r["token"]: r["suggestion"] for r in G.token_suggestions(asked, catalog).collect()}
    assert got == {"01-strat": "01-start", "02-something-else": "02-middle", "77-nothing-like-it": None}


def test_heading_paths(spark):
    df = spark.createDataFrame([("Details", ["Part one", "Chapter two", "Section"]), ("Details", ["Chapter two"]), ("Other", ["Part one"])], "heading string, ancestors array<string>")
    match = lambda path: [r[0] for r in df.select(I.heading_matches(F.col("heading"), F.col("ancestors"), path)).collect()]
    assert match(["Details"]) == [True, True, False] and match(["Part", "Section", "Details"]) == [True, False, False]
    assert match(["Section", "Part", "Details"]) == [False, False, False] and match(["one", "Other"]) == [False, False, True]


def test_paragraphs_and_places(spark):
    text = "one。\ntwo three\n\n- item\nmore。end\n# head\n| cell | next |"
    pars = L.paragraphs(R.lines(frame(spark, text), "text", "doc_id"), "doc_id")
    assert [(r["start"], r["stop"], r["text"]) for r in pars.orderBy("start").collect()] == [(1, 2, "one。two three"), (4, 5, "- itemmore。end"), (6, 6, "# head"), (7, 7, "| cell | next |")]
    parts = L.located_parts(pars, "doc_id").orderBy("start", "offset").collect()
    assert [(r["part"], r["line"]) for r in parts][:4] == [("one。", 1), ("two three", 2), ("- itemmore。", 4), ("end", 5)]
    before = pars.select(L.line_at(F.col("places"), F.lit(-1)).alias("x"), "start").collect()
    assert all(r["x"] == r["start"] for r in before)


@pytest.mark.parametrize(("text", "want"), [("---\n", [(1, "trailing")]), ("a\n---\n# x", []), ("a\n\n***\n\n# x", [(3, "before_heading")]), ("a\n\n---\n\n## x", []), ("a\n\n---\n\n---\n\nb", []), ("```\n\n---\n```\nb", []), ("a\n\n_ _ _\nb", [])])
def test_stray_breaks(spark, text, want):
    assert [(r["line"], r["kind"]) for r in L.stray_breaks(frame(spark, text), "doc_id").orderBy("line").collect()] == want


@pytest.mark.parametrize(("text", "want"), [("AはBと同じように動かない。", "と同じように"), ("AはBと同じように少ない。", None), ("Aはない、Bと同様に動く。", None), ("Aと同様にB、Cと同じく見えません", "と同様に"), (None, None)])
def test_ambiguous_comparisons(spark, text, want):
    assert frame(spark, text).select(L.ambiguous_comparison(F.col("text"))).first()[0] == want


def test_manual_terms_and_front_matter(spark):
    docs = frame(spark, "[用語|ようご] and [plain] `[code]`\n```\n[fenced]\n```\n^[note] [link](u) [^1] [Hz] [|]", "[plain|reading] [用語]")
    assert {(r["term"], r["reading"], r["doc_id"]) for r in I.manual_terms(docs).collect()} == {("用語", "ようご", 0), ("plain", "plain", 0), ("|", "|", 0)}
    lines = L.front_matter(R.lines(frame(spark, "---\na\n---\nb", "a\n---\nb", "---\na"), "text", "doc_id"), "doc_id")
    assert {(r["doc_id"], r["line"]) for r in lines.where("front").collect()} == {(0, 1), (0, 2), (0, 3), (2, 1), (2, 2)}


def test_names_macros_and_comments(spark):
    d = frame(spark, "Einstein's (1)__a.", "()", "x")
    assert [r[0] for r in d.select(L.safe_name(F.col("text"))).collect()] == ["Einsteins 1_a", "image", "x"]
    assert frame(spark, "@version @titles @title").select(L.value_macros(F.col("text"), {"version": r"1\0$", "title": "<t>"})).first()[0] == "1\\0&#36; @titles &lt;t&gt;"
    assert frame(spark, "a<!--x\ny-->b<!-- z").select(L.blank_comments(F.col("text"))).first()[0] == "a     \n    b<!-- z"


def test_definitions_with_and_without_their_signs(spark):
    from folioquarry.operators import terms as T

    texts = ["組版とは文字を並べることである。", "「版面」は紙の上の領域。", "索引については後で。", "索引に関しての話", "目次を説明する。", "余白の概念、行間の意味", "no definition here", "版面は広い"]
    docs = frame(spark, *texts)
    every = sorted(tuple(r) for r in T.extract(docs, T.DEFINITIONS, "definition").collect())
    assert sorted(tuple(r) for r in T.extract(docs, T.DEFINITIONS, "definition", sign=T.DEFINING).collect()) == every and len(every) >= 6

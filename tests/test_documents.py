"""Markdown, metrics and checks on small texts with known answers."""

import pytest
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X
from folioquarry.operators import checks as C
from folioquarry.operators import dictionaries as S
from folioquarry.operators import metrics as M
from folioquarry.operators import terms as T
from folioquarry.sources import records as R

CODE = "# 見出し\n\n本文です。`code`も。\n\n```ruby\nputs 'hello'\n```\n\n> ````\n> ```\n> ````\nend"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_fences():
    assert D.code_lines(CODE) == [False] * 4 + [True] * 3 + [False] + [True] * 3 + [False]
    assert D.code_lines("~~~\n```\n~~~\nx") == [True, True, True, False]
    assert D.strip_code(CODE).count("\n") == CODE.count("\n") and "hello" not in D.strip_code(CODE)
    text, held = D.protect_code(CODE)
    assert "hello" not in text and D.restore_code(text, held) == CODE


def test_emphasis():
    assert D.strip_emphasis("a **b *c* d** e") == ("a b c d e", [0, 1, 4, 5, 7, 9, 10, 13, 14])
    assert D.strip_emphasis("snake_case_name")[0] == "snake_case_name"


@pytest.mark.parametrize(("n", "w"), [(0, 5), (3, 5), (5, 5), (40, 7)])
def test_mattr(n, w):
    words = [str(k * k % 11) for k in range(n)]
    windows = [words[k : k + w] for k in range(max(1, n - w + 1))]
    want = sum(len(set(x)) / len(x) for x in windows if x) / max(1, len(windows))
    assert D.mattr(words, w) == pytest.approx(want)


def test_outline_and_containers(spark):
    text = "# A\n## B\ntext\n### C\n## D\n```\n# no\n```\n# E"
    got = C.headings(docs(spark, text), "doc_id").collect()
    assert [(r["heading"], r["level"], r["ancestors"], r["last"]) for r in got] == [("A", 1, [], 8), ("B", 2, ["A"], 4), ("C", 3, ["A", "B"], 4), ("D", 2, ["A"], 8), ("E", 1, [], 9)]
    t = C.toc(C.headings(docs(spark, text), "doc_id"), "doc_id").orderBy("line").collect()
    assert [(r["opened"], r["closed"]) for r in t] == [(1, 0), (1, 0), (1, 0), (0, 1), (0, 1)]
    assert D.container_faults("::: note\n:::\n:::\n::: x\n::: y\n:::") == [{"line": 3, "fault": "surplus"}, {"line": 4, "fault": "unclosed"}]
    assert C.container_issues(docs(spark, "::: x\na"), "doc_id").first()["message"] == "container fence is unclosed"


def test_sentences(spark):
    assert D.located_sentences("一つ目の文。二つ\n目の文！\n\n# 題\n三つ目？") == [{"line": 1, "sentence": "一つ目の文。", "length": 6}, {"line": 1, "sentence": "二つ目の文！", "length": 6}, {"line": 5, "sentence": "三つ目？", "length": 4}]
    r = M.basic_stats(docs(spark, "一つ目の文。二つ目の文！三つ目の文？", "", None)).orderBy("doc_id").collect()
    assert [x["sentences"] for x in r] == [3, 0, 0] and r[1]["lines"] == 0 and r[1]["avg_sentence"] == 0.0 and r[0]["clauses"] == 1


def test_tables_and_dialogue():
    t = D.pipe_table("| a | b |  |\n|:--|--:|:-:|\n| x \\| y |  | z |\n")
    assert t["align"] == ["left", "right", "center"] and t["header"] == [[{"text": "a", "colspan": 1}, {"text": "b", "colspan": 2}]]
    assert t["body"] == [[{"text": "x | y", "colspan": 2}, {"text": "z", "colspan": 1}]] and D.pipe_table("no table") is None
    assert D.utterances("A: hi\n  more\nB：ok\n") == [{"speaker": "A", "lines": ["hi", "more"]}, {"speaker": "B", "lines": ["ok"]}]


def test_width_and_similarity():
    assert D.display_width("aあ") == 3 and D.truncate("あいうえ", 5) == "あい…" and D.truncate("abc", 3) == "abc"
    assert D.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4) and D.jaro_winkler("a", "b") == 0
    assert D.greedy_spans([(0, 2), (0, 5), (4, 6), (5, 7)]) == [(0, 5), (5, 7)]
    assert [D.kanji_level(c) for c in "亜弌𠮟"] == [2, 3, 4]


def test_volumes_add_up(spark):
    r = M.volumes(docs(spark, CODE)).first()
    assert r["prose_chars"] + r["code_chars"] + r["notation_chars"] == len("".join(CODE.split())) and r["code_chars"] > 0


def test_readability(spark):
    r = M.readability(docs(spark, "漢字。", "")).orderBy("doc_id").collect()
    assert r[0]["score"] == pytest.approx(69.19, abs=1e-3) and r[0]["label"] == "Easy" and r[1]["score"] == 115.79
    two = docs(spark, "漢字。", "ひらがなだけの文です。")
    scores = [x["score"] for x in M.readability(two).collect()]
    assert M.corpus_readability(two).first()["score"] != pytest.approx(sum(scores) / 2)


def test_commas_count_by_full_stops(spark):
    # 2 sentences of 4 and 6 characters, 1 full stop, 2 commas; runs: hiragana あ い う え お, none else
    r = M.readability(docs(spark, "あ、い、う！え、お。")).first()
    assert (r["commas"], r["periods"], r["sentences"]) == (3, 1, 2)
    assert r["score"] == pytest.approx(115.79 - 0.12 * (5 + 3) / 2 + 7.4 * 1 - 4.67 * 3 / 1, abs=1e-9) and r["label"] == "Easy"


def test_few_documents_take_the_preset_of_their_total(spark):
    few = spark.createDataFrame([(k, 20_000) for k in range(4)], "doc_id int, chars int")
    t = M.relative_thresholds(few, "chars").first()
    assert (t["low"], t["ideal_low"], t["ideal_high"], t["high"]) == (4200, 4800, 8500, 9700)
    many = spark.createDataFrame([(k, 1000) for k in range(5)], "doc_id int, chars int")
    assert tuple(M.relative_thresholds(many, "chars").first())[1:] == (650, 800, 1200, 1500)


def test_numbering_by_ranges(spark):
    from folioquarry.operators.numbering import numbered

    rows = [(k % 7, None if k % 50 == 0 else k * 31 % 101, k) for k in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, w int")
    got = sorted((r["n"], r["a"]) for r in numbered(df, "a", "b", "w", name="n").collect())
    assert [n for n, _ in got] == list(range(1, 301)) and [a for _, a in got] == sorted(a for a, _, _ in rows)
    sums = numbered(df, "a", "b", "w", weight="w").orderBy("a", "b", "w").collect()
    total = 0
    for r in sums:
        total += r["w"]
        assert r["_hi"] == total
    assert numbered(df.limit(0), "a", name="n").count() == 0


def test_sections_and_runs(spark):
    r = M.sections(docs(spark, "intro\n## One\nab c\n\n## Two\nd"), "doc_id").orderBy("section").collect()
    assert [(x["heading"], x["chars"]) for x in r] == [("One", 3), ("Two", 1)]
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("aaaaabbaaaaaa")], "d int, pos int, v string")
    assert sorted((x["n"], x["first_pos"]) for x in M.runs(rows, ["d"], ["pos"], "v").collect()) == [(5, 0), (6, 7)]
    assert M.preset_for(34_999) == "compact" and M.preset_for(200_000) == "heavy"


@pytest.mark.parametrize(("text", "kind"), [("これは本です", "です"), ("そうでしたか？", "その他"), ("読みませんでした。", "ませんでした"), ("そうである。", "である"), ("名詞の終わり。体言", "体言止め"), ("そうだ！", "だ"), ("ね", "その他")])
def test_endings(spark, text, kind):
    assert one(spark, X.sentence_ending, text) == kind


def test_scalars(spark):
    assert one(spark, X.to_mm, "1in") == pytest.approx(25.4) and one(spark, X.to_mm, "3") == 3.0
    assert one(spark, lambda c: X.kana_row(c, F.lit("漢字")), "カンジ") == "か" and one(spark, lambda c: X.kana_row(F.lit("x"), c), "9x") == "0-9"
    assert one(spark, X.language_of, "a/b.rb") == "ruby" and one(spark, X.ascii_slug, "Hello, World!") == "hello-world"
    assert one(spark, lambda c: X.dice(c, F.lit("abd")), "abc") == pytest.approx(2 / 3)
    assert one(spark, lambda c: c.rlike(T.term_pattern("CMYK")), "CMYK版") and not one(spark, lambda c: c.rlike(T.term_pattern("CMYK")), "XCMYK")


def test_labels_and_references(spark):
    d = docs(spark, "## Intro @intro\n** Table one @t1 **\nsee @t1 and @pageref:gone, not a@b.c, `@code`, [@x](https://y/@z), https://u/@v or @today", "**Again @t1**")
    got = C.resolve(C.references(d, "doc_id"), C.labels(d, "doc_id"))
    ids = {k: sorted(r["id"] for r in v.collect()) for k, v in got.items()}
    assert ids == {"resolved": ["t1"], "undefined": ["gone"], "orphans": ["intro"], "duplicates": ["t1"]}


def test_suppression_and_findings(spark):
    text = "a\n<!-- lint-disable -->\nb\n<!-- lint-enable -->\nc\n<!-- lint-disable-next-line -->\nd\ne"
    got = C.suppressed(R.lines(docs(spark, text), "text", "doc_id"), "doc_id").orderBy("line").collect()
    assert [r["content"] for r in got if r["skipped"] and not r["content"].startswith("<")] == ["b", "d"]
    hits = spark.createDataFrame([(1, "ab"), (1, "abc"), (2, "ab")], "line int, hit string")
    assert sorted(tuple(r) for r in C.drop_subsumed(hits, ["line"], "hit").collect()) == [(1, "abc"), (2, "ab")]
    found = spark.createDataFrame([("r", "l", k % 12) for k in range(24)], "rule string, label string, line int")
    assert C.findings_summary(found).first()["lines"] == "0, 1, 2, 3, 4, 5, 6, 7, 8, 9 …"


def test_suggestions_agree_with_all_pairs(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 10)))
    entries, asked = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})
    from test_support import distance

    most = lambda w: 1 if len(w) <= 4 else 2 if len(w) <= 8 else 3
    want = {}
    for w in asked:
        near = [(distance(w, e), k, e) for k, e in enumerate(entries) if distance(w, e) <= most(w)]
        if near:
            want[w] = min(near)[2]
    got = C.suggestions(spark.createDataFrame([(w,) for w in asked], "key string"), spark.createDataFrame([(e, k) for k, e in enumerate(entries)], "key string, ord int"))
    assert {r["key"]: r["suggestion"] for r in got.collect()} == want


def test_suggestions_for_long_words(spark):
    import random

    from test_support import distance

    rng = random.Random(6)
    entries = sorted({"".join(rng.choices("abcd", k=rng.randint(8, 40))) for _ in range(40)})
    asked = ["x" * 100]
    for e in entries:
        chars = list(e)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        asked.append("".join(chars))
    asked = sorted({w for w in asked if len(w) >= 12})
    want = {}
    for w in asked:
        near = [(distance(w, e), k, e) for k, e in enumerate(entries) if distance(w, e) <= 3]
        if near:
            want[w] = min(near)[2]
    got = C.suggestions(spark.createDataFrame([(w,) for w in asked], "key string"), spark.createDataFrame([(e, k) for k, e in enumerate(entries)], "key string, ord int"))
    assert {r["key"]: r["suggestion"] for r in got.collect()} == want and len(want) > 15


def test_structure_checks(spark):
    d = docs(spark, "```\nx", "[a](javascript:x) http://a.b/c http://d.e http://a.b/c")
    assert C.fence_issues(d, "doc_id").count() == 1 and C.scheme_issues(d, "doc_id").count() == 1
    assert sorted((r["url"], r["note"]) for r in C.url_footnotes(d, "doc_id").collect()) == [("http://a.b/c", 1), ("http://d.e", 2)]
    a, b = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["1", "2"], ["2", "3"]))
    assert {r["id"]: r["state"] for r in C.footnotes(a, b).collect()} == {"1": "missing", "2": "ok", "3": "unused"}


def test_dictionaries(spark):
    kind = "term string, reading string, flags string, definition string"
    old, new = spark.createDataFrame([("a", "x", "g", "d"), ("b", "y", "i", None)], kind), spark.createDataFrame([("a", "", "i", "e"), ("c", "z", "i", None)], kind)
    got = {r["term"]: (r["reading"], r["flags"], r["definition"]) for r in S.merge_terms(old, new).collect()}
    assert got == {"a": ("x", "ig", "e"), "b": ("y", "i", None), "c": ("z", "i", None)}
    assert {r["term"] for r in S.remove_flag(old, "a", "g").collect()} == {"b"} and S.insert_absent(old, new).count() == 3
    words = S.upsert_words(spark.createDataFrame([("Beta",)], "word string"), spark.createDataFrame([("beta",), ("alpha",)], "word string"))
    assert [r["word"] for r in words.collect()] == ["alpha", "Beta"]
    assert S.free_number(spark.createDataFrame([(1,), (2,), (4,)], "n int"), "n") == 3
    assert [r["number"] for r in S.renumber(spark.createDataFrame([(k,) for k in range(30)], "k int"), "k", 1, 5).orderBy("k").collect()][:3] == [1, 4, 7]


def test_sources(spark, tmp_path):
    (tmp_path / "01-a.md").write_text("# x\n", encoding="utf-8")
    (tmp_path / "02_b.md").write_text("no", encoding="utf-8")
    (tmp_path / "books.json").write_text('[{"id": 1, "tags": "a, b"}]', encoding="utf-8")
    (tmp_path / "words.txt").write_text("# c\nFoo/ab\nbar-baz # x\n", encoding="utf-8")
    got = R.read_markdown(spark, str(tmp_path / "*.md")).collect()
    assert [(r["basename"], r["chapter_num"], r["content"]) for r in got] == [("01-a", 1, "# x\n")]
    assert R.read_json(spark, str(tmp_path / "books.json"), multi=("tags",)).first()["tags"] == ["a", "b"]
    assert {r["key"] for r in R.read_words(spark, str(tmp_path / "words.txt")).collect()} == {"foo", "bar-baz", "barbaz"}
    assert R.table_path("d", "book", ["books.yml", "x.yml"]) == "d/books.yml" and R.expand_numbers([0, "5-3", 9]) == [0, 3, 4, 5, 9]
    tree = {"chapters": [{"Part 1": ["11-a", "21-23"]}], "preface": ["00-pre"], "junk": 1}
    assert [(r["section"], r["part"], r["basename"]) for r in R.read_catalog(spark, tree).orderBy("ord").collect()] == [("preface", None, "00-pre"), ("chapters", "Part 1", "11-a"), ("chapters", "Part 1", "21"), ("chapters", "Part 1", "22"), ("chapters", "Part 1", "23")]
    assert [r["line"] for r in R.lines(docs(spark, "a\nb\n"), "text", "doc_id").collect()] == [1, 2]


def test_cache_and_report(spark):
    d = docs(spark, "a", "b")
    cached = spark.createDataFrame([(0, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", 1), (1, "old", 1)], "doc_id long, digest string, version int")
    assert [r["doc_id"] for r in M.stale(d, cached).collect()] == [1]
    assert '"stats":[' in M.report(d, d.limit(1), d.limit(0)).first()["report"]


def test_index_pages(spark):
    p = spark.createDataFrame([("b", 1, 3), ("b", 1, 9), ("b", 2, 1), ("a", 5, 0)], "term string, doc_id long, pos int")
    numbered = {(r["term"], r["doc_id"], r["pos"]): r["occurrence"] for r in T.number_occurrences(p).collect()}
    assert numbered == {("b", 1, 3): 1, ("b", 1, 9): 2, ("b", 2, 1): 3, ("a", 5, 0): 1}
    assert sorted((r["term"], r["doc_id"], r["pos"]) for r in T.coverage_top(p, 2).collect()) == [("a", 5, 0), ("b", 1, 3), ("b", 2, 1)]
    assert [r["row"] for r in T.index_page(T.inverted_index(p)).collect()] == ["A", "B"]
    r = spark.createDataFrame([("m", 1.0, True), ("r", 2.0, False)], "term string, score double, manual boolean")
    c = spark.createDataFrame([("n", 100.0), ("o", 50.0), ("r", 3.0)], "term string, score double")
    assert {x["term"]: x["band"] for x in T.ranking_bands(r, c, 1).collect()} == {"n": "recommended", "o": "general", "r": "review", "m": "kept"}

import random
import string

import pytest

from folioquarry.plans import template
from folioquarry.plans.querystream import Engine, Filter, Lookup, QueryError, bind, parse, singular
from folioquarry.sources.records import records

BOOKS = [
    {"title": "楽しいRuby", "author": {"name": "A", "bio": "x"}, "tags": ["ruby", "beginner"], "cover": "a.webp", "year": 2020},
    {"title": "Ruby deep", "author": {"name": "B", "bio": None}, "tags": "ruby, javascript", "cover": "", "year": 2022},
    {"title": "C", "author": {"name": "C", "bio": "z"}, "tags": ["c"], "cover": None, "year": 2018},
    {"title": "Meta", "author": {"name": "D", "bio": "w"}, "tags": ["ruby", "advanced"], "cover": "d.webp", "year": 2022},
]


@pytest.fixture(scope="module")
def books(spark):
    return records(spark, BOOKS, multi=("tags",))


@pytest.fixture()
def engine(books):
    return Engine({"books": books}, {"books": "_ord"})


def titles(df):
    return [r["title"] for r in df.collect()]


@pytest.mark.parametrize(
    ("line", "field", "want"),
    [
        ("= books | tags=ruby, javascript", "filters", (Filter("tags", "eq", ["ruby", "javascript"]),)),
        ("= books | tags = ruby && beginner", "filters", (Filter("tags", "eq", ["ruby", "beginner"], "all"),)),
        ("= books | year=2018..2020", "filters", (Filter("year", "range", (2018, 2020, True)),)),
        ("= books | year=2018...2020", "filters", (Filter("year", "range", (2018, 2020, False)),)),
        ("= books | year=2018..", "filters", (Filter("year", "gte", 2018),)),
        ("= books | year=..2018", "filters", (Filter("year", "lte", 2018),)),
        ("= books | year=...2018", "filters", (Filter("year", "lt", 2018),)),
        ("= books | year>=2018 AND price<3.5", "filters", (Filter("year", "gte", 2018), Filter("price", "lt", 3.5))),
        ("= books | author.name!=A", "filters", (Filter("author.name", "neq", ["A"]),)),
        ("= books | -year | 3 | :full", "sort", ("year", "desc")),
        ("= books | 3 | +year", "limit", 3),
        ("= books | :full.html", "style", "full.html"),
        ("= book | 楽しいRuby", "lookup", Lookup("楽しいRuby")),
        ("= prefecture | 13", "lookup", Lookup(13)),
        ("= books | some title", "lookup", Lookup("some title")),
    ],
)
def test_parse(line, field, want):
    assert getattr(parse(line), field) == want


@pytest.mark.parametrize("line", ["=", "= ", "| x", "= books | =3", "= books | year="])
def test_bad_lines(line):
    with pytest.raises(QueryError):
        parse(line)


def test_fuzz():
    rng = random.Random(20260615)
    pool = "= books|tags=ruby,&&AND..<>!:+-13 \t\x00漢\n" + string.printable
    for _ in range(3000):
        try:
            parse("".join(rng.choices(pool, k=rng.randint(0, 40))))
        except QueryError:
            pass


@pytest.mark.parametrize(("word", "one"), [("books", "book"), ("categories", "category"), ("boxes", "box"), ("wolves", "wolf"), ("class", "class"), ("physics_books", "physics_book"), ("books_2", "book_2"), ("part", "part")])
def test_singular(word, one):
    assert singular(word) == one


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("= books | tags=ruby", ["楽しいRuby", "Ruby deep", "Meta"]),
        ("= books | tags=ruby && tags=beginner", ["楽しいRuby"]),
        ("= books | tags=ruby && beginner", ["楽しいRuby"]),
        ("= books | tags=c, javascript", ["Ruby deep", "C"]),
        ("= books | -title", ["楽しいRuby", "Ruby deep", "Meta", "C"]),
        ("= books | 2", ["楽しいRuby", "Ruby deep"]),
        ("= books | year!=2022", ["楽しいRuby", "C"]),
        ("= books | -year", ["Meta", "Ruby deep", "楽しいRuby", "C"]),
        ("= books | author.name=B", ["Ruby deep"]),
        ("= books | cover!=a.webp", ["Ruby deep", "C", "Meta"]),
        ("= book | Meta", ["Meta"]),
        ("= books | year=2018...2022 | +year", ["C", "楽しいRuby"]),
    ],
)
def test_run(engine, line, want):
    assert titles(engine.query(line)) == want


def test_lookups(engine, spark):
    assert engine.one("= book | 存在しない本") is None and engine.issues[0].category == "lookup"
    df = spark.createDataFrame([(1, "x", "y"), (2, "1", "z")], "id int, name string, title string")
    assert [r["id"] for r in bind(parse("= thing | 1"), df).collect()] == [1]  # id goes before name


def test_dates(spark):
    df = spark.createDataFrame([("2026-02-01",), ("2026-03-05",), ("bad",)], "date string")
    assert [r[0] for r in bind(parse("= w | date=2026-02-02..2026-12-31"), df).collect()] == ["2026-03-05"]
    typed = df.selectExpr("try_to_date(date) AS date")
    assert bind(parse("= w | date>=2026-03-01"), typed).count() == 1
    with pytest.raises(QueryError):
        bind(parse("= w | date=2026-02-29"), typed)


def test_unknown_columns_get_a_hint(engine):
    with pytest.raises(QueryError, match="did you mean title"):
        engine.query("= books | titel=x")
    with pytest.raises(QueryError, match="did you mean cover"):
        template.check_keys("= covr", engine.tables("books"))


def test_render(engine, books):
    text = "| Title | Author |\n|---|---|\n| {title} | {author.name} |\n![x](cover)\n![fixed](images/logo.png)"
    got = template.render(engine.query("= books | 2"), text, "_ord")
    assert got == "| Title | Author |\n|---|---|\n| 楽しいRuby | A |\n![x](a.webp)\n![fixed](images/logo.png)\n\n| Ruby deep | B |"
    assert template.render(engine.query("= books | year=2018"), "=title\n\nby = author.bio", "_ord") == "C\n\nby z"


def test_expand_keeps_fences_and_failing_lines(engine):
    text = "a\n= books | tags=c\n```\n= books\n```\n= nothing | 1\n= book | 存在しない本\nend"
    got = template.expand(text, engine, {"books": "* {title}"})
    assert got == "a\n* C\n```\n= books\n```\n= nothing | 1\n\nend"
    assert any("no table nothing" in i.message for i in engine.issues)

"""Prose lines, paragraphs, page breaks, numbering and names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X
from folioquarry.operators import metrics as M
from folioquarry.sources.records import lines

# Fixed values of the notation: a page break, a heading, the beginning of a block, the ends of sentences in a paragraph.
BREAK = r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$"
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.*)$"
BLOCK_START = r"^[ \t]*(?:[-*+][ \t]|\d+[.)][ \t]|\||#+[ \t]|>)"
SENTENCE_BREAK = r"(?<=。)|(?<=\|)"
# Comparisons, negations, and words that look like a negation.
COMPARISON = r"と同じよう[にな]|と同様[にのな、]|と同じく"
NEGATION = r"ない|ませ[んぬ]|ずに|ず[、。」）]|ぬ[。」）]"
NOT_NEGATION = "少ない|危ない|もったいない|情けない|切ない|はかない|あどけない|だらしない|とんでもない|さりげない|何気ない|違いない|他ならない"
# Fixed value: signs that break a build or a book where they stand in the name of an image.
UNSAFE = r"[()'\x22&<>#?%\\:*|\x00-\x1f]"
SECTION_TOO_SHORT, SECTION_TOO_LONG = M.SECTION[0], M.SECTION[3]


def front_matter(each: DataFrame, key: str) -> DataFrame:
    """Lines (key, line, content) with front: in the block between a first line of three hyphens and the next one."""
    mark = F.col("content").rlike(rf"^---{X.WS}*$")
    opened = F.max(F.when((F.col("line") == 1) & mark, True)).over(W.partitionBy(key))
    closing = F.min(F.when((F.col("line") > 1) & mark, F.col("line"))).over(W.partitionBy(key))
    return each.withColumn("front", F.coalesce(opened, F.lit(False)) & (F.col("line") <= F.coalesce(closing, F.lit(2**31 - 1))))


def paragraphs(each: DataFrame, key: str) -> DataFrame:
    """(key, start, stop, text, places) of prose lines (key, line, content): joined up to an empty line, a gap or a new block.

    places: (offset, line) of each line of a paragraph; its lines are collected, not the document's.
    """
    d = each.withColumn("body", F.trim(F.regexp_replace("content", rf"^{X.WS}+|{X.WS}+$", "")))
    w = W.partitionBy(key).orderBy("line")
    gap = F.lag("line").over(w) != F.col("line") - 1
    new = (F.col("body") == "") | F.col("body").rlike(BLOCK_START) | F.coalesce(gap, F.lit(True)) | F.coalesce(F.lag("body").over(w) == "", F.lit(False))
    d = d.withColumn("_n", new.cast("int")).withColumn("_p", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).where("body <> ''")
    d = d.withColumn("_end", F.sum(F.length("body")).over(W.partitionBy(key, "_p").orderBy("line")))
    rows = F.array_sort(F.collect_list(F.struct("line", "body", (F.col("_end") - F.length("body")).cast("int").alias("offset"))))
    g = d.groupBy(key, "_p").agg(F.min("line").alias("start"), F.max("line").alias("stop"), rows.alias("r"))
    return g.select(key, "start", "stop", F.array_join(F.col("r.body"), "").alias("text"), F.transform("r", lambda x: F.struct(x["offset"].alias("offset"), x["line"].alias("line"))).alias("places"))


def line_at(places: Column, offset: Column) -> Column:
    """The line of the last place that begins at or before an offset; before all of them, the first."""
    before = F.filter(places, lambda p: p["offset"] <= offset)
    return F.coalesce(F.try_element_at(before, F.lit(-1))["line"], F.try_element_at(places, F.lit(1))["line"])


def located_parts(pars: DataFrame, key: str) -> DataFrame:
    """(key, start, part, offset, line): the sentences of paragraphs with the line that each begins on."""
    d = pars.withColumn("_s", F.split("text", SENTENCE_BREAK))
    ends = lambda k: F.aggregate(F.slice("_s", 1, k), F.lit(0), lambda a, s: a + F.length(s))
    d = d.select(key, "start", "places", F.posexplode(F.transform("_s", lambda s, k: F.struct(s.alias("part"), ends(k).alias("offset")))).alias("pos", "x"))
    return d.select(key, "start", "pos", "x.part", "x.offset", line_at(F.col("places"), F.col("x.offset")).alias("line")).where("part <> ''")


def ambiguous_comparison(c: Column) -> Column:
    """The first comparison that a negation follows in a sentence (it can be read in two ways), or null."""
    pieces = F.split(c, f"(?={COMPARISON})")
    found = F.transform(pieces, lambda p, k: F.when(p.rlike(f"^(?:{COMPARISON})") & F.regexp_replace(F.regexp_replace(F.array_join(F.slice(pieces, k + 1, F.size(pieces)), ""), f"^(?:{COMPARISON})", ""), NOT_NEGATION, "").rlike(NEGATION), F.regexp_extract(p, f"^({COMPARISON})", 1)))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def kept_findings(found: DataFrame, disabled: list[str], allowed: list[str] | None = None, rule: str = "rule", text: str = "message") -> DataFrame:
    """Findings without those of disabled rules and without those whose text an allowed pattern matches."""
    out = found.where(~F.col(rule).isin(*disabled)) if disabled else found
    for p in allowed or []:
        out = out.where(~F.col(text).rlike(p))
    return out


def blank_comments(c: Column) -> Column:
    """HTML comments as blanks of the same length; line feeds stay, so places and lines stay."""
    comment = r"(?s)<!--.*?-->"
    blanks = F.transform(F.regexp_extract_all(c, F.lit(f"({comment})"), 1), lambda x: F.regexp_replace(x, r"[^\n]", " "))
    return F.array_join(F.zip_with(F.split(c, comment, -1), blanks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def stray_breaks(docs: DataFrame, key: str, text: str = "text", section_breaks: bool = True) -> DataFrame:
    """(key, line, kind, heading): page breaks with nothing after them (trailing) or a heading (before_heading).

    A break stands after an empty line or at the start. Breaks before another break are meant; so are those before a
    second-level heading where sections begin a page themselves. Code is left out.
    """
    each = lines(docs.withColumn(text, D.strip_code_col(F.col(text))), text, key)
    w = W.partitionBy(key).orderBy("line")
    ahead = F.first(F.when(F.trim("content") != "", F.col("content")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    d = each.withColumns({"_prev": F.lag("content").over(w), "_next": ahead})
    d = d.where(F.col("content").rlike(BREAK) & (F.col("_prev").isNull() | (F.trim("_prev") == "")))
    level = F.length(F.regexp_extract("_next", HEADING, 1))
    kind = F.when(F.col("_next").isNull(), "trailing").when(F.col("_next").rlike(BREAK) | ~F.col("_next").rlike(HEADING), None).when((level == 2) & F.lit(section_breaks), None).otherwise("before_heading")
    return d.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "line", "kind", F.trim("_next").alias("heading"))


def section_numbers(heads: DataFrame, key: str, order: str, chapter: Column | None = None, letter: Column | None = None) -> DataFrame:
    """Second-level headings with number: letter-n in an appendix, chapter-n in a chapter, else n."""
    n = F.row_number().over(W.partitionBy(key).orderBy(order)).cast("string")
    front = F.coalesce(*[c.cast("string") for c in (letter, chapter) if c is not None], F.lit(None).cast("string"))
    return heads.withColumn("number", F.coalesce(F.concat_ws("-", front, n), n))


def part_numbers(parts: DataFrame, title: str, order: str, chapters: str) -> DataFrame:
    """Parts that have chapters, numbered in their order; with the first chapter. One catalog's parts."""
    d = parts.where(F.size(chapters) > 0)
    return d.withColumns({"number": F.row_number().over(W.orderBy(order)), "first_chapter": F.element_at(chapters, 1)})


def footnote_numbers(refs: DataFrame, key: str, order: str, note: str = "note") -> DataFrame:
    """(key, note, number): notes numbered by the first reference to each; a later reference to one keeps its number."""
    first = refs.groupBy(key, note).agg(F.min(order).alias("_o"))
    return first.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("_o"))).drop("_o")


def safe_name(c: Column) -> Column:
    """The name of an image (without extension) without unsafe signs; 'image' where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, UNSAFE, "")), "_{2,}", "_"), r"\.+$", "")
    return F.when(out == "", "image").otherwise(out)


def unsafe_signs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"({UNSAFE})"), 1))


def corpus_basic(stats: DataFrame, *by: str) -> DataFrame:
    """Sums over rows of basic_stats; means are weighted by what they are means of."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    mean = lambda m, n: X.safe_average(F.sum(F.col(m) * F.col(n)), F.sum(n)).alias(m)
    return stats.groupBy(*by).agg(*[total(c) for c in ("chars", "chars_no_newline", "lines", "sentences", "clauses", "commas")], mean("avg_sentence", "sentences"), mean("avg_clause", "clauses"))


def section_warnings(sections: DataFrame, chars: str = "chars") -> DataFrame:
    return sections.withColumn("warning", X.volume_class(chars, F.lit(SECTION_TOO_SHORT), F.lit(SECTION_TOO_LONG)))


def chapter_summary(df: DataFrame, chars: str) -> DataFrame:
    """One row: how many chapters, their characters, and the rounded mean."""
    return df.agg(F.count("*").alias("chapters"), F.sum(chars).cast("long").alias("total"), F.round(F.avg(chars)).cast("long").alias("average"))


def visible(df: DataFrame, warnings: str = "warnings", only_warned: bool = True) -> DataFrame:
    return df.where(F.size(warnings) > 0) if only_warned else df


def kanji_counts(docs: DataFrame, text: str = "text", levels: DataFrame | None = None) -> DataFrame:
    """(char, level, n) of the kanji of all texts; levels (char, level) of a table go before the computed ones."""
    each = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\p{IsHan})"), 1)).alias("char")).groupBy("char").agg(F.count("*").alias("n"))
    level = D._series(lambda c: str(D.kanji_level(c)), "string")(F.col("char"))
    if levels is None:
        return each.withColumn("level", level)
    return each.join(F.broadcast(levels.select("char", F.col("level").cast("string").alias("_l"))), "char", "left").withColumn("level", F.coalesce("_l", level)).drop("_l")  # a school table of some 2,000 rows


def rarest(counts: DataFrame, places: DataFrame, most: int = 15, each: int = 5) -> DataFrame:
    """(char, n, nth, key, line): the rarest characters with their first places, ordered by the first place of each."""
    chosen = counts.orderBy("n", "char").limit(most)
    order = [c for c in places.columns if c != "char"]
    p = places.distinct().join(F.broadcast(chosen.select("char", "n")), "char")
    p = p.withColumn("nth", F.row_number().over(W.partitionBy("char").orderBy(*order))).where(F.col("nth") <= each)
    return p.select("char", "n", "nth", *order)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def value_macros(c: Column, values: dict[str, str]) -> Column:
    """@name of each value in a text, where the name ends; values are escaped for HTML."""
    for name, value in values.items():
        safe = value.replace("\\", "\\\\")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("$", "&#36;")):
            safe = safe.replace(a, b)
        c = F.regexp_replace(c, rf"@{name}(?![A-Za-z0-9_])", safe)
    return c

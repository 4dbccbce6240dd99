"""The index workflow: markup by hand, candidates, review lines, main references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X
from folioquarry.operators import dictionaries as S
from folioquarry.operators import terms as T

# Fixed values of the notation: a term with a reading, one without, one of bars only; notes and links are something else.
WITH_READING = r"(?<!\^)\[([^\]|]+\|[^\]]+)\]"
WITHOUT_READING = r"(?<!\^)\[([^\]|]+)\](?!\()"
BARS = r"\[(\|+)\]"
# Fixed values of a review line: flags, a mark, the term, its reading, the rest; the score in the rest; main references in the flags.
REVIEW_LINE = r"^- \[([^\]]*)\](?: `(NEW!|Today)`)? \*\*(.+?)\*\* \(([^)]+)\)(.*)$"
SCORE = r"- スコア:\s*([\d.]+)"
MAIN = r"^([^m]*)m(\??)(.*)$"
WIDE_RATIO = 0.33
NO_CHAPTER = "zzz"


def manual_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, reading, key): terms marked by hand outside code, the first place of each (by document, kind of markup, place).

    Kinds are tried in the order: with a reading, without one, bars only. Notes, links, URLs and, without a reading, one or
    two ASCII signs are no terms.
    """
    bare = docs.select(key, D.strip_code_col(F.col(text)).alias("t"))
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.regexp_extract_all("t", F.lit(p), 1).alias("found")) for n, p in enumerate((WITH_READING, WITHOUT_READING, BARS))])
    each = bare.select(key, F.explode(kinds).alias("k")).select(key, "k.kind", F.posexplode("k.found").alias("pos", "raw"))
    raw = F.col("raw")
    ok = (F.col("kind") != 1) | (~raw.startswith("^") & ~raw.rlike("^https?:") & ~raw.rlike(T.SHORT_ASCII))
    split = F.col("kind") == 0
    term = F.trim(F.when(split, F.substring_index(raw, "|", 1)).otherwise(raw))
    reading = F.trim(F.when(split, F.expr("substr(raw, instr(raw, '|') + 1)")).otherwise(raw))
    each = each.where(ok).select(term.alias("term"), F.struct(F.col(key), "kind", "pos", reading.alias("reading")).alias("at"))
    return each.groupBy("term").agg(F.min("at").alias("at")).select("term", "at.reading", F.col(f"at.{key}").alias(key))


def short_terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, keys): units and symbols that markup without a reading would have registered, with the documents that hold them."""
    raw = docs.select(key, F.explode(F.regexp_extract_all(D.strip_code_col(F.col(text)), F.lit(WITHOUT_READING), 1)).alias("term"))
    short = raw.where(F.col("term").rlike(T.SHORT_ASCII) & ~F.col("term").startswith("^")).distinct()
    return short.groupBy("term").agg(F.min(key).alias("first"), F.count("*").alias("documents"))


def selectable_states(candidates: DataFrame, registered: DataFrame, rejected: DataFrame, key: str = "term") -> DataFrame:
    """Candidates with state: selectable, or rejected (counted, not shown); those already registered are dropped."""
    left = candidates.join(registered.select(key).distinct(), key, "left_anti")
    out = left.join(rejected.select(key).distinct().withColumn("_r", F.lit(True)), key, "left")
    return out.withColumn("state", F.when(F.col("_r"), "rejected").otherwise("selectable")).drop("_r")


def with_readings(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidates (term) with reading: the one that the dictionary has, else the term itself; remains of notation dropped."""
    first = known.groupBy("term").agg(F.min("reading").alias("_k"))
    return candidates.where(~T.garbage_term("term")).join(first, "term", "left").withColumn("reading", F.coalesce("_k", "term")).drop("_k")


def fill_scores(rejected: DataFrame, candidates: DataFrame) -> DataFrame:
    """rejected (term, score) with a missing score taken from the candidates."""
    return rejected.join(candidates.select("term", F.col("score").alias("_s")), "term", "left").withColumn("score", F.coalesce("score", "_s")).drop("_s")


def wide_without_main(spread: DataFrame, mains: DataFrame, ratio: float = WIDE_RATIO) -> DataFrame:
    """Terms in a large share of the groups that have no main reference; for whole catalogs only."""
    return spread.where(F.col("ratio") >= ratio).join(mains.select("term").distinct(), "term", "left_anti")


def unscanned(catalog: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Catalog entries that a scan has not recorded."""
    return catalog.join(recorded.select(key).distinct(), key, "left_anti")


def review_lines(df: DataFrame, line: Column | str) -> DataFrame:
    """df with flags, main (chapters, or null), suggested, term, yomi, label, score of the lines that are review lines."""
    c = F.col(line) if isinstance(line, str) else line
    part = lambda k: F.regexp_extract(c, REVIEW_LINE, k)
    d = df.where(c.rlike(REVIEW_LINE)).withColumn("_f", F.trim(part(1)))
    named = F.col("_f").rlike(MAIN)
    mains = F.filter(F.transform(F.split(F.regexp_extract("_f", MAIN, 3), "[,、]"), lambda x: F.trim(x)), lambda x: x != "")
    return d.withColumns({
        "flags": F.when(named, F.regexp_extract("_f", MAIN, 1)).otherwise(F.col("_f")), "main": F.when(named & (F.size(mains) > 0), mains),
        "suggested": named & (F.regexp_extract("_f", MAIN, 2) == "?"), "term": part(3), "yomi": part(4),
        "label": F.nullif(part(2), F.lit("")), "score": F.regexp_extract(part(5), SCORE, 1).try_cast("double"),
    }).drop("_f")


def review_line(flags: Column, main: Column, suggested: Column, label: Column, term: Column, yomi: Column, score: Column) -> Column:
    """The line of a term; main references stand in the flags where all are chapter numbers."""
    fits = F.coalesce((F.size(main) > 0) & F.forall(main, lambda m: m.rlike(r"^\d+$")), F.lit(False))
    inner = F.concat(flags, F.when(fits, F.concat(F.lit("m"), F.when(suggested, "?").otherwise(""), F.array_join(main, ","))).otherwise(""))
    mark = F.coalesce(F.concat(F.lit(" `"), label, F.lit("`")), F.lit(""))
    rest = F.coalesce(F.concat(F.lit(" - スコア: "), score.cast("string")), F.lit(""))
    return F.concat(F.lit("- ["), inner, F.lit("]"), mark, F.lit(" **"), term, F.lit("** ("), yomi, F.lit(")"), rest)


def review_label(is_new: Column, approved_at: Column, now: Column) -> Column:
    """NEW! before Today (approved since midnight) before none."""
    return F.when(is_new, "NEW!").when(approved_at >= F.date_trunc("day", now), "Today")


def review_order(label: Column, chapter: Column, term: Column) -> list[Column]:
    """Order of a review file: label, then the first chapter (missing ones last), then the term."""
    return [F.when(label == "NEW!", 0).when(label == "Today", 1).otherwise(2).alias("priority"), F.coalesce(chapter, F.lit(NO_CHAPTER)).alias("chapter"), term]


def main_path(c: Column) -> tuple[Column, Column]:
    """chapter and path of `chapter#heading#...`; blank parts are dropped."""
    parts = F.transform(F.split(c, "#"), lambda x: F.trim(x))
    return F.element_at(parts, 1), F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")


def distinct_contexts(contexts: DataFrame, chapter: str = "chapter", context: str = "context", order: list[str] | None = None) -> DataFrame:
    """Contexts once for each (chapter, text), the first in the given order; missing values count as 'unknown' and ''."""
    d = contexts.withColumns({chapter: F.coalesce(F.col(chapter).cast("string"), F.lit("unknown")), context: F.coalesce(context, F.lit(""))})
    return S.first_by(d, [chapter, context], order or [chapter])


def longest_first(terms: DataFrame, term: str = "term", order: str = "ord") -> DataFrame:
    return terms.orderBy(F.desc(F.length(term)), order)


def main_first(places: DataFrame, is_main: str = "is_main", order: str = "pos") -> DataFrame:
    return places.orderBy(F.desc(is_main), order)


def link_totals(index: DataFrame, links: str = "links") -> DataFrame:
    """One row: entries and the links of all of them."""
    return index.agg(F.count("*").alias("entry_count"), F.coalesce(F.sum(F.size(links)), F.lit(0)).cast("long").alias("link_count"))


def within_ranges(hits: DataFrame, ranges: DataFrame, key: list[str], line: str = "line", low: str = "low", high: str = "high") -> DataFrame:
    """Hits whose line lies in a range of the same key (both ends included), each once: an equi-join on the key with a condition."""
    r = ranges.select(*key, F.col(low).alias("_lo"), F.col(high).alias("_hi"))
    return hits.join(r, key).where(F.col(line).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi").distinct()


def first_landing(hits: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first qualifying place of each key (a main reference lands once a term and chapter; a glossary link likewise)."""
    rest = [c for c in hits.columns if c not in (*key, order)]
    return hits.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in (order, *rest)])


# What an extraction of candidates does not read: tags, container lines, attributes, addresses of links, inline code.
SANITISE = ((r"<[^>]+>", " "), (r"(?m)^:::[^\n]*$", " "), (r"\{[^}]*\}", " "), (r"\]\([^)]+\)", "] "), (r"`[^`]+`", " "), (rf"{X.WS}+", " "))
# What a comparison of headings leaves out: code marks, emphasis, readings, index marks, white space.
HEADING_MARKS = ((r"`([^`]*)`", "$1"), (r"\*{1,3}([^*]*)\*{1,3}", "$1"), (r"\{([^|}]*)\|[^}]*\}", "$1"), (r"\[([^\]|]*)(?:\|[^\]]*)?\]", "$1"), (r"[\s　]+", ""))


def _chain(c: Column, steps: tuple) -> Column:
    for pattern, put in steps:
        c = F.regexp_replace(c, pattern, put)
    return c


def sanitised(c: Column, code: bool = True) -> Column:
    """Text as the extraction of candidates reads it; code: fenced and inline code off first."""
    return _chain(D.strip_code_col(c) if code else c, SANITISE)


def heading_key(c: Column) -> Column:
    return _chain(c, HEADING_MARKS)


def _holds(want: str):
    return lambda a: a.contains(want)


def heading_matches(heading: Column, ancestors: Column, path: list[str]) -> Column:
    """Whether a heading (as heading_key) contains the last part of a path and its ancestors the others in their order."""
    ok, rest = heading.contains(path[-1]), ancestors
    for want in path[:-1]:
        at = F.array_position(F.transform(rest, _holds(want)), True)
        ok, rest = ok & (at > 0), F.slice(rest, (at + 1).cast("int"), F.greatest(F.size(rest), F.lit(1)))
    return F.coalesce(ok, F.lit(False))


def occurrences_in_order(hits: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return hits.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy(*order)))

"""Spelling, references, links and structure: every check ends in rows of one issues table.

issues: (chapter, line, severity, category, message)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X
from folioquarry.sources.records import lines

# Fixed values of the notation: a label's id; a caption (bold, its title and id) and a heading with an id; a reference, and
# one with a page; spans in which @ means something else; ids that are macros or ask for a number.
_ID = r"@([\w-]+)"
CAPTION = rf"^\*\*{X.WS}*(.+?){X.WS}+{_ID}{X.WS}*\*\*{X.WS}*$"
HEADING_LABEL = rf"^#{{1,6}}{X.WS}+(.+?){X.WS}+{_ID}{X.WS}*$"
REFERENCE = rf"(?<![a-zA-Z0-9_.]){_ID}"
PAGE_REFERENCE = r"@pageref:([\w-]+)"
MASKED = r"`+[^`]*`+|!?\[[^\]]*\](?:\([^)]*\))?|https?://[^\s)]+"
RESERVED = ("auto", "omakase", "id", "vspace", "hspace", "pagebreak", "pageref", "version", "today", "title", "qr")
#: From this length on, words meet on pieces.
LONG_WORD = 12
DANGEROUS = r"(?i)\b(javascript|data|vbscript|file):"
URL = r"https?://[^\s)\x22'<>]+"


def issues(df: DataFrame, chapter: str, line: Column, severity: str, category: str, message: Column) -> DataFrame:
    return df.select(F.col(chapter).alias("chapter"), line.cast("int").alias("line"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"))


def issue_counts(found: DataFrame, by: str = "chapter") -> DataFrame:
    return found.groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])


# --- spelling ---------------------------------------------------------------


def words_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, word) that a spelling check looks at."""
    return lines(docs, text, key).select(key, "line", F.explode(X.english_words("content")).alias("word"))


def unknown_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows whose word, in lower case, is no key of the dictionary."""
    return words.withColumn("key", F.lower("word")).join(dictionary.select("key").distinct(), "key", "left_anti")


def spelling_summary(unknown: DataFrame, *doc: str) -> DataFrame:
    """(word, n_lines): distinct lines, not hits."""
    return unknown.groupBy("key").agg(F.count_distinct(*doc, "line").alias("n_lines"))


def suggestions(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(key, suggestion, distance): the nearest dictionary word within the distance that the length allows.

    Exact by deletion neighbourhoods: two words within distance d share a string that is left after d deletions at most from
    each, so candidates come from an equi-join on those strings instead of a comparison of all pairs. Words of LONG_WORD
    letters and more have too many such strings; they meet on whole pieces. dictionary has (key, ord); the first of the
    nearest wins.
    """
    limit = lambda c: F.when(F.length(c) <= 4, 1).when(F.length(c) <= 8, 2).otherwise(3)

    def cuts(c: Column, times: int) -> Column:
        out = F.array(c)
        for _ in range(times):
            one = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))
            out = F.array_distinct(F.concat(out, one))
        return out

    left = words.select("key").distinct().withColumn("most", limit(F.col("key")))
    entries = dictionary.select(F.col("key").alias("entry"), "ord")
    ws = None
    for n, low, high in ((1, 0, 4), (2, 5, 8), (3, 9, LONG_WORD - 1)):
        a = left.where(F.length("key").between(low, high)).withColumn("cut", F.explode(cuts(F.col("key"), n)))
        b = entries.where(F.length("entry").between(low - n, high + n)).withColumn("cut", F.explode(cuts(F.col("entry"), n)))
        part = a.join(b, "cut").select("key", "most", "entry", "ord").distinct()
        ws = part if ws is None else ws.union(part)
    ws = ws.union(_long_pairs(left.where(F.length("key") >= LONG_WORD), entries.where(F.length("entry") >= LONG_WORD - 3)))
    ws = ws.withColumn("distance", F.levenshtein("key", "entry")).where("distance <= most")
    return ws.groupBy("key").agg(F.min(F.struct("distance", "ord", "entry")).alias("b")).select("key", F.col("b.entry").alias("suggestion"), F.col("b.distance").alias("distance"))


def _long_pairs(words: DataFrame, entries: DataFrame, d: int = 3) -> DataFrame:
    """(key, most, entry, ord) that share one of d + 1 even pieces of the entry at a place at most d off: d edits leave one whole.

    A word has at most (2d + 1)^2 (d + 1) such strings, whatever its length.
    """
    at = lambda i, m: F.floor(i * m / (d + 1)).cast("int")
    pieces = entries.withColumn("m", F.length("entry")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d))))
    pieces = pieces.withColumn("cut", F.substr("entry", at(F.col("i"), F.col("m")) + 1, at(F.col("i") + 1, F.col("m")) - at(F.col("i"), F.col("m"))))
    w = words.withColumn("m", F.explode(F.sequence(F.length("key") - d, F.length("key") + d))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(d)))).withColumn("off", F.explode(F.sequence(F.lit(-d), F.lit(d))))
    start, size = at(F.col("i"), F.col("m")) + F.col("off"), at(F.col("i") + 1, F.col("m")) - at(F.col("i"), F.col("m"))
    w = w.where((start >= 0) & (start + size <= F.length("key"))).select("key", "most", "m", "i", F.substr("key", start + 1, size).alias("cut")).distinct()
    return w.join(pieces, ["m", "i", "cut"]).select("key", "most", "entry", "ord").distinct()


def findings_summary(found: DataFrame) -> DataFrame:
    """(rule, label, n, lines): by count, with the first ten lines."""
    rows = found.groupBy("rule", "label").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line")).alias("ls"))
    shown = F.concat(F.array_join(F.slice("ls", 1, 10), ", "), F.when(F.size("ls") > 10, " …").otherwise(""))
    return rows.select("rule", "label", "n", shown.alias("lines"))


def suppressed(each: DataFrame, key: str, tool: str = "lint") -> DataFrame:
    """Lines (key, line, content) with skipped: between disable and enable marks, or after a next-line mark."""
    w = W.partitionBy(key).orderBy("line")
    mark = F.regexp_extract("content", rf"<!--\s*{tool}-(disable-next-line|disable|enable)\s*-->", 1)
    d = each.withColumn("_m", mark)
    state = F.last(F.when(F.col("_m").isin("disable", "enable"), F.col("_m")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("skipped", F.coalesce(state == "disable", F.lit(False)) | F.coalesce(F.lag("_m").over(w) == "disable-next-line", F.lit(False))).drop("_m")


def drop_subsumed(hits: DataFrame, key: list[str], text: str) -> DataFrame:
    """Hits that are not part of a longer hit of the same line."""
    other = hits.select(*key, F.col(text).alias("_other"))
    longer = hits.join(other, key).where((F.length("_other") > F.length(text)) & F.col("_other").contains(F.col(text))).select(*key, text).distinct()
    return hits.join(longer, [*key, text], "left_anti")


# --- labels and references ---------------------------------------------------


def labels(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(id, key, line, title, kind, number): numbered within (key, kind) in the order of lines."""
    each = lines(docs, text, key)
    heading = F.regexp_extract("content", HEADING_LABEL, 2)
    caption = F.regexp_extract("content", CAPTION, 2)
    d = each.withColumn("id", F.when(heading != "", heading).when(caption != "", caption)).where("id IS NOT NULL")
    d = d.withColumns({"kind": F.when(heading != "", "heading").otherwise("caption"), "title": F.when(heading != "", F.regexp_extract("content", HEADING_LABEL, 1)).otherwise(F.regexp_extract("content", CAPTION, 1))})
    return d.withColumn("number", F.row_number().over(W.partitionBy(key, "kind").orderBy("line"))).drop("content")


def references(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, id) of references, with or without a page, outside code, links, brackets and URLs; labels of their own and macros left out."""
    each = lines(docs.withColumn(text, D.strip_code_col(F.col(text))), text, key)
    each = each.where(~F.col("content").rlike(CAPTION) & ~F.col("content").rlike(HEADING_LABEL))
    bare = F.regexp_replace("content", MASKED, " ")
    paged, plain = F.regexp_extract_all(bare, F.lit(PAGE_REFERENCE), 1), F.regexp_extract_all(F.regexp_replace(bare, PAGE_REFERENCE, " "), F.lit(REFERENCE), 1)
    return each.select(key, "line", F.explode(F.concat(paged, plain)).alias("id")).where(~F.col("id").isin(*RESERVED))


def resolve(refs: DataFrame, targets: DataFrame, on: str = "id") -> dict[str, DataFrame]:
    """resolved, undefined and orphan rows; duplicated ids keep their first target."""
    order = [c for c in targets.columns if c != on]
    first = targets.withColumn("_k", F.row_number().over(W.partitionBy(on).orderBy(*order))).where("_k = 1").drop("_k")
    return {
        "resolved": refs.join(first.select(on).distinct(), on, "left_semi"),
        "undefined": refs.join(first, on, "left_anti"),
        "orphans": first.join(refs, on, "left_anti"),
        "duplicates": targets.groupBy(on).agg(F.count("*").alias("n")).where("n > 1"),
    }


def links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, target, kind) of each link of a page."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)).alias("pos", "target"))
    kind = F.when(F.col("target").rlike(DANGEROUS), "dangerous").when(F.col("target").rlike("^https?://"), "external").when(F.col("target").startswith("#"), "anchor").otherwise("internal")
    return each.withColumn("kind", kind)


def footnotes(refs: DataFrame, definitions: DataFrame, on: str = "id") -> DataFrame:
    """(id, state) of a full outer match: ok, missing (no definition) or unused."""
    a, b = refs.select(on).distinct().withColumn("_r", F.lit(1)), definitions.select(on).distinct().withColumn("_d", F.lit(1))
    return a.join(b, on, "full_outer").select(on, F.when(F.col("_r").isNull(), "unused").when(F.col("_d").isNull(), "missing").otherwise("ok").alias("state"))


def url_footnotes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, url, note): one number for each URL of a document, by first appearance."""
    each = docs.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(f"({URL})"), 1)).alias("pos", "url"))
    first = each.groupBy(key, "url").agg(F.min("pos").alias("pos"))
    return first.withColumn("note", F.row_number().over(W.partitionBy(key).orderBy("pos"))).drop("pos")


# --- structure ---------------------------------------------------------------


def container_issues(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    each = docs.select(key, F.explode(D.rows_of(D.container_faults, F.col(text))).alias("f"))
    return issues(each, key, F.col("f.line"), "error", "container", F.concat(F.lit("container fence is "), F.col("f.fault")))


def fence_issues(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    each = lines(docs, text, key).where(F.col("content").rlike("^ {0,3}```"))
    odd = each.groupBy(key).agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n % 2 = 1")
    return issues(odd, key, F.col("line"), "error", "fence", F.lit("a code fence is not closed"))


def scheme_issues(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    bad = lines(docs, text, key).withColumn("scheme", F.regexp_extract("content", r"\]\(\s*" + DANGEROUS, 1)).where("scheme <> ''")
    return issues(bad, key, F.col("line"), "error", "link", F.concat(F.lit("dangerous scheme: "), "scheme"))


def headings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, level, heading, ancestors, last) of each heading outside code."""
    return docs.select(key, F.explode(D.rows_of(D.outline, F.col(text))).alias("h")).select(key, "h.*")


def toc(heads: DataFrame, key: str) -> DataFrame:
    """Headings with opened and closed: how many list levels begin and end before each."""
    step = F.col("level") - F.coalesce(F.lag("level").over(W.partitionBy(key).orderBy("line")), F.lit(0))
    return heads.withColumns({"opened": F.greatest(step, F.lit(0)), "closed": F.greatest(-step, F.lit(0))})


def orphan_files(listing: DataFrame, catalog: DataFrame, on: str = "basename") -> DataFrame:
    """Files that no catalog entry names, both in composed form."""
    return listing.withColumn(on, D.nfc(F.col(on))).join(catalog.withColumn(on, D.nfc(F.col(on))).select(on), on, "left_anti")


def dialogue(rows: DataFrame, conv: str, turn: str, speaker: str, registry: DataFrame | None = None) -> DataFrame:
    """Utterances with the speaker's side (alternating by position) and name (the key, where the registry has none)."""
    n = F.row_number().over(W.partitionBy(conv).orderBy(turn))
    out = rows.withColumn("side", F.when(n % 2 == 1, "left").otherwise("right"))
    if registry is None:
        return out.withColumn("name", F.col(speaker))
    return out.join(F.broadcast(registry.select(F.col("key").alias(speaker), F.col("name").alias("_n"))), speaker, "left").withColumn("name", F.coalesce("_n", speaker)).drop("_n")  # a cast list

"""Guards and imports: classes of containers, catalogs against files, images, included code, findings of other tools."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X
from folioquarry.operators import checks as C
from folioquarry.operators import dictionaries as S
from folioquarry.sources.records import lines

# Noise of a style sheet, a class selector, the opening line of a container and a class in it.
CSS_NOISE = ((r"(?s)/\*.*?\*/", " "), (r"\x22[^\x22]*\x22|'[^']*'", " "))
CSS_CLASS = r"\.([A-Za-z_][\w-]*)"
CONTAINER = r"^\s*:{3,}\s*\{([^}]*)\}"
#: An image is looked for under these extensions, in this order, after its own.
IMAGE_EXTENSIONS = ("webp", "png", "jpg", "jpeg", "svg", "gif")
LIBRARY_VERSION = 1
LONGEST_DEFINITION = 400
_MESSAGES = "array<struct<filePath:string,messages:array<struct<ruleId:string,line:int,message:string>>>>"


def css_classes(sheets: DataFrame, css: str = "css") -> DataFrame:
    """(class): names of class selectors, without those in comments and strings."""
    c = F.col(css)
    for pattern, put in CSS_NOISE:
        c = F.regexp_replace(c, pattern, put)
    return sheets.select(F.explode(F.regexp_extract_all(c, F.lit(CSS_CLASS), 1)).alias("class")).distinct()


def container_classes(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, class) of the classes that containers are opened with, outside code."""
    each = lines(docs.withColumn(text, D.strip_code_col(F.col(text))), text, key)
    inner = F.regexp_extract("content", CONTAINER, 1)
    return each.select(key, "line", F.explode(F.regexp_extract_all(inner, F.lit(CSS_CLASS), 1)).alias("class"))


def unknown_classes(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Uses of classes that no style sheet knows, with the nearest known one (by edit distance) or null."""
    unknown = used.join(known.select("class").distinct(), "class", "left_anti")
    entries = known.select(F.col("class").alias("key"), F.col("class").alias("ord")).distinct()
    near = C.suggestions(unknown.select(F.col("class").alias("key")), entries).select(F.col("key").alias("class"), "suggestion")
    return unknown.join(near, "class", "left").select(key, "line", "class", "suggestion")


def token_suggestions(unknown: DataFrame, catalog: DataFrame, token: str = "token", name: str = "basename") -> DataFrame:
    """unknown with suggestion: the nearest catalog entry, else the first that begins with the same number."""
    entries = catalog.select(F.col(name).alias("key"), F.col(name).alias("ord")).distinct()
    near = C.suggestions(unknown.select(F.col(token).alias("key")), entries).select(F.col("key").alias(token), F.col("suggestion").alias("_near"))
    number = lambda c: F.regexp_extract(c, r"^(\d+)", 1)
    same = catalog.select(number(F.col(name)).alias("_n"), name).where("_n <> ''").groupBy("_n").agg(F.min(name).alias("_same"))
    out = unknown.withColumn("_n", number(F.col(token))).join(near, token, "left").join(same, "_n", "left")
    return out.withColumn("suggestion", F.coalesce("_near", "_same")).drop("_n", "_near", "_same")


def lint_messages(reports: DataFrame, report: str = "report") -> DataFrame:
    """(file, line, rule, message) of a linter's JSON; what is no such JSON gives nothing."""
    files = reports.select(F.explode(F.from_json(report, _MESSAGES)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    return files.select(F.col("filePath").alias("file"), "m.line", F.col("m.ruleId").alias("rule"), "m.message")


def entry_states(catalog: DataFrame, listing: DataFrame, on: str = "basename") -> DataFrame:
    """Catalog entries with state: ok, or missing where no file has the name."""
    return catalog.join(listing.select(on).distinct().withColumn("_f", F.lit(True)), on, "left").withColumn("state", F.when(F.col("_f"), "ok").otherwise("missing")).drop("_f")


def rebuilt_catalog(listing: DataFrame, number: str = "number", on: str = "basename") -> DataFrame:
    """(ord, kind, basenames): the chapter files by kind, in the fixed order of kinds, each list by number and name."""
    order = F.create_map(*[F.lit(x) for k, v in enumerate(("preface", "chapter", "appendix", "postface")) for x in (v, k)])
    kinds = listing.withColumn("kind", X.chapter_kind(number)).where("kind IS NOT NULL")
    names = F.transform(F.array_sort(F.collect_list(F.struct(number, on))), lambda x: x[on])
    return kinds.groupBy("kind").agg(names.alias("basenames")).select(order[F.col("kind")].alias("ord"), "kind", "basenames")  # one book's files


def _variants(path: Column) -> Column:
    """A path as it is, then with each other extension."""
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")
    return F.array_distinct(F.concat(F.array(path), F.array(*[F.concat(stem, F.lit("." + e)) for e in IMAGE_EXTENSIONS])))


def resolved_images(refs: DataFrame, listing: DataFrame, places: list[Column], src: str = "src", path: str = "path") -> DataFrame:
    """refs with resolved: the first existing file among the places (columns of folders, in order) and, in each, the extensions.

    Only plain file names are looked for; others, and those that no place has, keep null. One equi-join on the candidates.
    """
    plain = ~F.col(src).contains("/") & ~F.col(src).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (F.col(src) != "")
    tries = F.flatten(F.array(*[_variants(F.concat_ws("/", p, F.col(src))) for p in places]))
    d = refs.withColumn("_id", F.xxhash64(*[F.col(c) for c in refs.columns]))
    each = d.where(plain).select("_id", F.posexplode(tries).alias("_pos", "_try")).distinct()
    hits = each.join(listing.select(F.col(path).alias("_try")).distinct(), "_try").groupBy("_id").agg(F.min(F.struct("_pos", "_try")).alias("_b"))
    return d.join(hits.select("_id", F.col("_b._try").alias("resolved")), "_id", "left").drop("_id")


def included_code(refs: DataFrame, files: DataFrame, path: str = "path", code: str = "code", first: str = "first", last: str = "last") -> DataFrame:
    """refs (path, first, last) with text: the lines of a file; a range that is none gives the whole file, a long one its end."""
    rows = F.split(F.regexp_replace(F.col(code), r"\n\z", ""), "\n", -1)
    n = F.size(rows)
    bad = F.col(first).isNull() | (F.col(first) < 1) | (F.coalesce(F.col(last), F.col(first)) < F.col(first)) | (F.col(first) > n)
    start = F.when(bad, 1).otherwise(F.col(first))
    stop = F.when(bad, n).otherwise(F.least(F.coalesce(F.col(last), F.col(first)), n))
    return refs.join(files, path, "left").withColumn("text", F.array_join(F.slice(rows, start.cast("int"), (stop - start + 1).cast("int")), "\n")).drop(code)


def definition_issues(terms: DataFrame, most: int = LONGEST_DEFINITION, required: bool = False) -> DataFrame:
    """(term, severity, length): definitions whose plain text is too long (warning), and missing ones where required (error)."""
    size = F.length(X.no_space(X.strip_markdown(F.coalesce("definition", F.lit("")))))
    severity = F.when((size == 0) & F.lit(required), "error").when(size > most, "warning")
    return terms.select("term", severity.alias("severity"), size.alias("length")).where("severity IS NOT NULL")


# Candidates that a review does not show: colours, numbers, operators, tags.
HIDDEN = (r"^#?[0-9a-fA-F]{3,8}$", r"^[\d\s.,%]+$", r"^[=!<>&|+*/%^~-]+$", r"^</?[A-Za-z][^>]*>?$")


def shown_in_review(terms: DataFrame, term: str = "term", manual: str = "manual") -> DataFrame:
    hide = F.lit(False)
    for p in HIDDEN:
        hide = hide | F.col(term).rlike(p)
    return terms.where(F.coalesce(F.col(manual), F.lit(False)) | ~hide)


def anchor_pages(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(anchor, key): the first page (by key) that each id stands on."""
    ids = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit('id="([^"]+)"'), 1)).alias("anchor"))
    return ids.groupBy("anchor").agg(F.min(key).alias(key))


def write_library(terms: DataFrame, path: str) -> None:
    terms.withColumn("version", F.lit(LIBRARY_VERSION)).write.mode("overwrite").json(path)


def read_library(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The terms of a library; rows of another version are an error."""
    df = spark.read.schema(f"{schema}, version int").json(path)
    odd = df.where(~F.col("version").eqNullSafe(F.lit(LIBRARY_VERSION))).limit(1).collect()
    if odd:
        raise ValueError(f"library of version {odd[0]['version']}, not {LIBRARY_VERSION}")
    return df.drop("version")


def import_library(old: DataFrame, library: DataFrame) -> DataFrame:
    """Terms of a library beside one's own; one's own values win where both have one."""
    return S.merge_terms(old, library, prefer_new=False)


def edits(line: str, rules: list[tuple[str, str]], allowed: list[str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, stop, replacement, found) of regex rules on a line: from the left, the longest first, none over another."""
    hits = [(m.start(), m.end(), put, m[0]) for pattern, put in rules for m in re.finditer(pattern, line) if m[0]]
    hits = [h for h in hits if not any(re.fullmatch(a, h[3]) for a in allowed or [])]
    out: list[tuple[int, int, str, str]] = []
    for h in sorted(hits, key=lambda h: (h[0], h[0] - h[1])):
        if not out or h[0] >= out[-1][1]:
            out.append(h)
    return out


def replaced(c: Column, rules: list[tuple[str, str]], allowed: list[str] | None = None) -> Column:
    """A text with the edits of each line applied, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(line: str) -> str:
            for start, stop, put, _ in reversed(edits(line, rules, allowed)):
                line = line[:start] + put + line[stop:]
            return line

        return pd.Series([None if t is None else "\n".join(map(one, t.split("\n"))) for t in texts], dtype=object)

    return run(c)


def aligned(anchors: list[str], rows: list[str]) -> list[int | None]:
    """For each anchor the number (from 0) of the first line after the last match that has the same text, white space aside."""
    plain = lambda t: re.sub(r"\s+", "", t)
    where: dict[str, list[int]] = {}
    for k, row in enumerate(rows):
        where.setdefault(plain(row), []).append(k)
    out, last = [], -1
    for a in anchors:
        hit = next((k for k in where.get(plain(a), []) if k > last), None)
        last = last if hit is None else hit
        out.append(hit)
    return out

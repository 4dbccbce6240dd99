"""Terms: extraction, scores, spread, ranking bands, postings and index pages.

A term dictionary is small beside a corpus: its size is checked against MAX_TERMS before it travels as literals; beyond
that, terms are worked off in chunks of that size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions import text as X
from folioquarry.operators.numbering import numbered

MAX_TERMS = 500
# Trait weights, TF-IDF scale, spread limits, heading weights, index size law and presets, band width.
TRAITS = {"definition": 30, "technical": 15, "noun_sequence": 10, "heading": 20}
SCALE = 30.0
SPREAD_DOCS, SPREAD_COUNT, SPREAD_RATIO = 6, 3, 0.5
HEADINGS = {1: 3, 2: 2, 3: 1}
BETA, BASE_CHARS, SIZES = 0.749, 50_000.0, {"light": (65, 90), "standard": (120, 175), "thorough": (225, 230)}
POOL, PAGE_LIMIT, MIN_RANGE = 3.0, 8, 3
# Characters of a term in a definition; phrases that define a term (its group); technical words.
TERM_CHAR = r"[^\s。、！？…「」『』（）()\[\]{}#*|`>~:：;；,，\\]"
DEFINITIONS = (
    f"({TERM_CHAR}{{2,20}})とは[、,]?[^。]*(?:である|です|を意味|を指|という)",
    f"({TERM_CHAR}{{2,20}})(?:について|に関して)(?:は|の)",
    f"({TERM_CHAR}{{2,20}})(?:を|が)(?:定義|説明|解説)",
    f"「({TERM_CHAR}{{2,20}})」(?:とは|は|について)",
    f"({TERM_CHAR}{{2,20}})(?:の概念|の定義|の意味)",
)
#: Every definition holds one of these; texts without any need no closer look.
DEFINING = "とは|について|に関して|[をが](?:定義|説明|解説)|」は|の概念|の定義|の意味"
TECHNICAL = (r"([ァ-ヶー]{3,})", r"([A-Z][a-zA-Z]{2,})", r"([A-Z]{2,})")
# What cannot be in a term: marks of the notation, punctuation, a blank or a mark at either end.
JUNK = r"[。、！？\r\n\t#*|`>~\[\]()（）「」『』【】]|:{3}|^[\s\-.:：]|[\s\-.:：]$"
#: Names of tags and attributes, sizes, percentages and mere signs.
NOT_TERMS = (r"[<>]", r"(?i)^(?:span|div|class|id|data-|href|src)$", r"^:::", r"^\{", r"\}$", r"^(?:width|height|align)=", r"^\d+%$", r"^[=\x22\-./:;,]+$", r"^(?:yomi|index-term|idx-)")
#: Terms of one or two ASCII signs are units and symbols; manual markup without a reading does not register them.
SHORT_ASCII = r"^[\x21-\x7E]{1,2}$"
# Remains of emphasis, colour codes and numbers.
GARBAGE = (r"^\*\*", r"\*\*$", r"^['\x22]?#[0-9a-fA-F]{3,8}['\x22]?$", r"^['\x22]?#[0-9a-fA-F]{3,8}['\x22]?,\s*['\x22]?#", r"^\d+$")


def term_pattern(term: str) -> str:
    """A literal term as a pattern; ASCII words end at ASCII word boundaries, also beside other scripts."""
    p = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)
    if re.match(r"[A-Za-z0-9_]", term):
        p = r"(?<![A-Za-z0-9_])" + p
    return p + r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9_]$", term) else p


def count_terms(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text", literal: bool = True) -> DataFrame:
    """(key, term, tf) of the terms that a text holds; each term is counted on its own, overlaps included."""
    out = None
    for a in range(0, len(terms), MAX_TERMS):
        pairs = [F.struct(F.lit(t).alias("term"), F.regexp_count(text, F.lit(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", t) if literal else term_pattern(t))).alias("tf")) for t in terms[a : a + MAX_TERMS]]
        part = docs.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.term", "x.tf").where("tf > 0")
        out = part if out is None else out.unionByName(part)
    return out


def tfidf(counts: DataFrame, n_docs: Column | int) -> DataFrame:
    """(term, tf, df, score) from (key, term, tf)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    agg = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    return agg.withColumn("score", (1 + F.log("tf")) * (F.log((n + 1) / (F.col("df") + 1)) + 1) * SCALE)


def extract(docs: DataFrame, patterns: tuple[str, ...], trait: str, text: str = "text", sign: str | None = None) -> DataFrame:
    """(term, trait, n) of valid terms that any of the patterns (one group each) finds; sign: what all that they match holds."""
    docs = docs if sign is None else docs.where(F.col(text).rlike(sign))
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), 1) for p in patterns]))
    each = docs.select(F.explode(found).alias("term")).where(valid_term("term"))
    return each.groupBy("term").agg(F.count("*").alias("n")).withColumn("trait", F.lit(trait))


def trait_bonus(traits: DataFrame) -> DataFrame:
    """(term, bonus): each trait counts once for a term."""
    weight = F.create_map(*[F.lit(x) for kv in TRAITS.items() for x in kv])
    return traits.select("term", "trait").distinct().groupBy("term").agg(F.sum(weight[F.col("trait")]).alias("bonus"))


def valid_term(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    ok = (F.length(c) >= 2) & ~c.rlike(JUNK)
    for p in NOT_TERMS:
        ok = ok & ~c.rlike(p)
    return F.coalesce(ok, F.lit(False))


def garbage_term(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    bad = c == ""
    for p in GARBAGE:
        bad = bad | c.rlike(p)
    return F.coalesce(bad, F.lit(True))


def spread(postings: DataFrame, total: int, group: str) -> DataFrame:
    """(term, groups, ratio, common) over a number of groups in all."""
    agg = postings.select("term", group).distinct().groupBy("term").agg(F.count("*").alias("groups"))
    ratio = F.col("groups") / F.lit(total)
    return agg.withColumn("ratio", ratio).withColumn("common", (F.lit(total) >= SPREAD_DOCS) & (F.col("groups") >= SPREAD_COUNT) & (ratio >= SPREAD_RATIO))


def ranking_bands(registered: DataFrame, candidates: DataFrame, target: int, pool: float = POOL) -> DataFrame:
    """(term, score, rank, band) of registered (term, score, manual) and candidates (term, score).

    Bands: recommended and general are unregistered terms up to the target and up to the pool; review are registered ones
    beyond the target that were not marked by hand; kept are the other registered ones; hidden lie beyond the pool.
    """
    r = registered.select("term", F.col("score").alias("rs"), "manual", F.lit(True).alias("registered"))
    j = r.join(candidates.select("term", F.col("score").alias("cs")), "term", "full_outer")
    j = j.select("term", F.coalesce("cs", "rs", F.lit(0.0)).alias("score"), F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("manual", F.lit(False)).alias("manual"))
    most = max(int(target * pool + 0.5), target)
    # the first `most` rows by one top-k; the rest needs no rank
    head = j.orderBy(F.desc("score"), "term").limit(most).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "term")))
    j = j.join(F.broadcast(head.select("term", "rank")), "term", "left") if most <= 100_000 else j.join(head.select("term", "rank"), "term", "left")
    band = (F.when(F.col("registered") & (F.col("manual") | (F.col("rank") <= target)), "kept").when(F.col("registered"), "review").when(F.col("rank") <= target, "recommended").when(F.col("rank").isNotNull(), "general").otherwise("hidden"))
    return j.withColumn("band", band).select("term", "score", "rank", "band")


def main_reference(hits: DataFrame, group: str = "doc_id") -> DataFrame:
    """(term, group, score): of (term, group, h1, h2, h3, body) the best group, ties to the smaller; two hits at least in all.

    One partial aggregation: the best row of a term is a minimum, so no task holds a term's pages.
    """
    score = sum((F.col(f"h{k}") * w for k, w in HEADINGS.items()), F.col("body"))
    d = hits.withColumn("score", score)
    best = d.groupBy("term").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(group))).alias("b"), F.sum(F.col("h1") + F.col("h2") + F.col("h3") + F.col("body")).alias("_n"))
    return best.where("_n >= 2").select("term", F.col(f"b.{group}").alias(group), (-F.col("b.s")).alias("score"))


def index_size(total_chars: Column) -> dict[str, tuple[Column, Column]]:
    growth = F.pow(total_chars / F.lit(BASE_CHARS), F.lit(BETA))
    return {name: (F.round(F.lit(a) * growth), F.round(F.lit(b) * growth)) for name, (a, b) in SIZES.items()}


def gap(n: Column, low: Column, high: Column) -> Column:
    return F.when(n < low, F.concat(F.lit("below by "), (low - n).cast("long").cast("string"))).when(n > high, F.concat(F.lit("above by "), (n - high).cast("long").cast("string"))).otherwise("within")


def score_quantiles(df: DataFrame, score: str, ratios: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75)) -> DataFrame:
    """Nearest-rank quantiles without a collected list: places are picked by running counts of the distinct scores."""
    total = df.agg(F.count("*").alias("_n"))
    counts = df.groupBy(score).agg(F.count("*").alias("_c"))
    at = numbered(counts, score, weight="_c").crossJoin(F.broadcast(total))  # one row
    places = F.array(*[F.struct(F.lit(r).alias("ratio"), F.least(F.floor(F.col("_n") * r), F.col("_n") - 1).alias("place")) for r in ratios], F.struct(F.lit(1.0).alias("ratio"), (F.col("_n") - 1).alias("place")))
    at = at.select(F.col(score).alias("value"), "_c", "_hi", F.explode(places).alias("p")).where("p.place < _hi AND p.place >= _hi - _c")
    return at.select("p.ratio", "value")


def postings(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, pos) of literal terms among the tokens of each text."""
    each = docs.select(key, F.posexplode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("pos", "term"))
    return each.where(F.col("term").isin(terms))


def number_occurrences(p: DataFrame, key: str = "doc_id") -> DataFrame:
    """Postings with occurrence (1-based over the corpus), is_definition (the first) and anchor.

    Counts per (term, document) get running sums over all terms and documents (numbered()); a term's own start is taken off.
    So a frequent term is spread over ranges of documents.
    """
    within = F.row_number().over(W.partitionBy("term", key).orderBy("pos"))
    per = numbered(p.groupBy("term", key).agg(F.count("*").alias("_c")), "term", key, weight="_c").withColumn("_b", F.col("_hi") - F.col("_c"))
    first = per.groupBy("term").agg(F.min("_b").alias("_f"))
    before = per.join(first, "term").select("term", key, (F.col("_b") - F.col("_f")).alias("_b"))
    out = p.withColumn("_w", within).join(before, ["term", key]).withColumn("occurrence", F.col("_b") + F.col("_w")).drop("_b", "_w")
    return out.withColumns({"is_definition": F.col("occurrence") == 1, "anchor": X.anchor_id("term", F.col("occurrence"))})


def coverage_top(p: DataFrame, k: int = PAGE_LIMIT, key: str = "doc_id") -> DataFrame:
    """Up to k postings of each term: the first of each document before any second, in their own order."""
    nth = F.row_number().over(W.partitionBy("term", key).orderBy("pos"))
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.when(F.col("nth") == 1, 0).otherwise(1), key, "pos"))
    return p.withColumn("nth", nth).withColumn("_r", rank).where(F.col("_r") <= k).select("term", key, "pos", "nth")


def page_ranges(df: DataFrame, key: list[str], page: str, breaks: list[str] | None = None, least: int = 1) -> DataFrame:
    """Consecutive pages of a key as (key..., first, last, n); not across a change of `breaks`; shorter ones stay single."""
    d = df.select(*key, page, *(breaks or [])).distinct()
    w = W.partitionBy(*key).orderBy(page)
    new = F.coalesce(F.col(page) != F.lag(page).over(w) + 1, F.lit(True))
    for b in breaks or []:
        new = new | ~F.col(b).eqNullSafe(F.lag(b).over(w))
    d = d.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = d.withColumn("_size", F.count("*").over(W.partitionBy(*key, "_g")))
    single = F.when(F.col("_size") < least, F.col(page))
    return g.withColumn("_one", single).groupBy(*key, "_g", "_one").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count("*").alias("n")).drop("_g", "_one")


def range_text(ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key..., pages) such as '10-12, 15'."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    parts = F.array_sort(F.collect_list(F.struct("first", one.alias("t"))))
    return ranges.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("pages"))


def keep_first_per_page(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_k = 1").drop("_k")


def contexts(docs: DataFrame, term: str, key: str = "doc_id", text: str = "text", most: int = 3, width: int = 40) -> DataFrame:
    """The first `most` documents that hold the term, with the words around its first place."""
    at = F.locate(term, F.col(text))
    hits = docs.where(F.col(text).contains(term)).orderBy(key).limit(most)
    return hits.select(key, X.kwic(text, at, F.lit(len(term)), width).alias("context"))


def inverted_index(p: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, total, postings): for index pages, whose postings coverage_top has bounded."""
    return p.groupBy("term").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.struct(key, "pos"))).alias("postings"))


def index_page(index: DataFrame, reading: str = "term", key: str = "doc_id") -> DataFrame:
    """HTML rows of an index in the order of its pages: kana row, then reading."""
    row = X.kana_row(reading, "term")
    item = F.concat(F.lit("<li>"), X.escape_html("term"), F.lit(" "), F.array_join(F.transform("postings", lambda p: p[key].cast("string")), ", "), F.lit("</li>"))
    return index.withColumns({"row": row, "html": item}).orderBy("row", reading, "term").select("row", "term", "html")

"""Document and corpus metrics. Per-document work stays in the row; corpus work is one partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X

# Chapter volume presets (too short below, ideal from-to, too long above) and the totals they serve.
PRESETS = {"compact": (800, 1100, 3400, 4200), "handy": (2900, 3400, 5700, 6800), "standard": (4200, 4800, 8500, 9700), "commercial": (6400, 7800, 14600, 17800), "heavy": (9200, 11000, 16000, 19600)}
PRESET_TOTALS = ((35_000, "compact"), (65_000, "handy"), (90_000, "standard"), (150_000, "commercial"))
RELATIVE, RELATIVE_LEAST = (0.65, 0.80, 1.20, 1.50), 5
SECTION = (400, 1000, 2800, 4000)
OUTLIERS, LONG_SENTENCE, LONGEST, TOP_WORDS, MIN_RUN = 3, 80, 5, 15, 5
MATTR_WINDOW, MONOTONOUS, COMPLEX_SENTENCES, MONOTONOUS_TOKENS = 100, 0.5, 10, 100


def basic_stats(docs: DataFrame, text: str = "text", prose: str | None = None) -> DataFrame:
    """docs with chars, chars_no_newline, lines, sentences, sentence_chars, avg_sentence, clauses, avg_clause, commas.

    prose: the column of the text without code and marks, where it differs from the text.
    """
    raw, body = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(prose or text), F.lit(""))
    df = docs.withColumns({"_s": X.sentences(body), "_c": X.clauses(body)})
    n, c = F.size("_s").cast("long"), F.size("_c").cast("long")
    chars, clause_chars = X.total_length(F.col("_s")), X.total_length(F.col("_c"))
    return df.withColumns({
        "chars": F.length(raw).cast("long"), "chars_no_newline": F.length(F.regexp_replace(raw, r"[\r\n]", "")).cast("long"),
        "lines": X.line_count(raw).cast("long"), "sentences": n, "sentence_chars": chars, "avg_sentence": X.safe_average(chars, n),
        "clauses": c, "avg_clause": X.safe_average(clause_chars, c), "commas": F.regexp_count(body, F.lit("[,、，]")).cast("long"),
    }).drop("_s", "_c")


def volumes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with prose, code_chars and notation_chars; the three parts add up to the characters that are not white space."""
    size = lambda c: F.length(X.no_space(c)).cast("long")
    bare = D.strip_code_col(F.coalesce(F.col(text), F.lit("")))
    df = docs.withColumn("_bare", bare).withColumn("prose", X.strip_markdown("_bare"))
    return df.withColumns({"prose_chars": size("prose"), "code_chars": size(text) - size("_bare"), "notation_chars": size("_bare") - size("prose")}).drop("_bare")


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with tokens (array), n_tokens, n_unique, ttr, avg_word."""
    df = docs.withColumn("tokens", X.tokens(F.coalesce(F.col(text), F.lit(""))))
    n = F.size("tokens").cast("long")
    unique = F.size(F.array_distinct("tokens")).cast("long")
    return df.withColumns({"n_tokens": n, "n_unique": unique, "ttr": X.safe_average(unique, n), "avg_word": X.safe_average(X.total_length(F.col("tokens")), n)})


def with_mattr(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    return df.withColumn("mattr", D.mattr_col(F.col(tokens)))


def char_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts of each character class and the share of kanji."""
    c = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(X.no_space(c))
    return docs.withColumns({**{f"{k}_chars": X.class_chars(c, k).cast("long") for k in X.CLASSES}, **{f"{k}_runs": X.class_runs(c, k).cast("long") for k in X.CLASSES}, "kanji_pct": X.safe_average(100.0 * X.class_chars(c, "kanji"), bare)})


def readability(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the feature sums, their score and its label."""
    df = docs.withColumns(X.readability_features(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("score", X.readability_score()).withColumn("label", X.readability_label(F.col("score")))


def corpus_readability(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """The score of groups of texts: features are summed first; scores are never averaged."""
    f = X.readability_features(F.coalesce(F.col(text), F.lit("")))
    return docs.select(*by, *[c.alias(k) for k, c in f.items()]).groupBy(*by).agg(*[F.sum(k).alias(k) for k in f]).withColumn("score", X.readability_score())


def corpus_vocabulary(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """Tokens, distinct tokens and the token-weighted MATTR of groups of texts.

    Distinct tokens are counted in two steps on (group, token), so no task holds a group's words.
    """
    df = with_mattr(vocabulary(docs, text))
    words = df.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    words = words.groupBy(*by).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_unique"))
    mean = df.groupBy(*by).agg(F.sum(F.col("mattr") * F.col("n_tokens")).alias("_w"), F.sum("n_tokens").alias("_n"))
    return words.join(mean, list(by)).withColumn("mattr", X.safe_average(F.col("_w"), F.col("_n"))).drop("_w", "_n") if by else words.crossJoin(mean).withColumn("mattr", X.safe_average(F.col("_w"), F.col("_n"))).drop("_w", "_n")  # one row each


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(X.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top(df: DataFrame, n: int, score: str, name: str) -> DataFrame:
    """The n largest, ties by name: one top-k, no full sort."""
    return df.orderBy(F.desc(score), name).limit(n)


def relative_thresholds(df: DataFrame, measure: str) -> DataFrame:
    """One row: the median and four thresholds: multiples of it, rounded; below RELATIVE_LEAST rows those of the total's preset."""
    m, names = F.median(measure), ("low", "ideal_low", "ideal_high", "high")
    total, few = F.sum(measure), F.count(measure) < RELATIVE_LEAST

    def preset(k: int) -> Column:
        out = None
        for most, name in PRESET_TOTALS:
            out = (F if out is None else out).when(total < most, float(PRESETS[name][k]))
        return out.otherwise(float(PRESETS["heavy"][k]))

    return df.agg(m.alias("median"), *[F.when(few, preset(k)).otherwise(F.round(m * RELATIVE[k])).alias(n) for k, n in enumerate(names)])


def preset_for(total: int) -> str:
    return next((name for most, name in PRESET_TOTALS if total < most), "heavy")


def volume_classes(df: DataFrame, measure: str) -> DataFrame:
    """df with volume_class by thresholds relative to the median."""
    t = relative_thresholds(df, measure).select("low", "high")
    return df.crossJoin(F.broadcast(t)).withColumn("volume_class", X.volume_class(measure, F.col("low"), F.col("high")))  # one row


def outliers(df: DataFrame, by: list[str], measure: str, name: str, most: int = OUTLIERS) -> DataFrame:
    """(by..., side, rank, name, measure): up to `most` rows a side that lie one population standard deviation off the mean."""
    stats = df.groupBy(*by).agg(F.avg(measure).alias("_m"), F.stddev_pop(measure).alias("_s"))
    j = df.join(stats, by) if by else df.crossJoin(F.broadcast(stats))  # one row
    j = j.where(F.col("_s") > 0).withColumn("side", F.when(F.col(measure) >= F.col("_m") + F.col("_s"), "high").when(F.col(measure) <= F.col("_m") - F.col("_s"), "low"))
    j = j.where(F.col("side").isNotNull())
    far = F.when(F.col("side") == "high", -F.col(measure)).otherwise(F.col(measure))
    rank = F.row_number().over(W.partitionBy(*by, "side").orderBy(far, name))
    return j.withColumn("rank", rank).where(F.col("rank") <= most).select(*by, "side", "rank", name, measure)


def runs(df: DataFrame, key: list[str], order: list[str], value: str, least: int = MIN_RUN, leave_out: str | None = None) -> DataFrame:
    """Gaps and islands: stretches of equal values within a key, at least so long: (key..., value, first order, n)."""
    a = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    b = F.row_number().over(W.partitionBy(*key, value).orderBy(*order))
    d = df.withColumn("_island", a - b)
    d = d if leave_out is None else d.where(F.col(value) != leave_out)
    out = d.groupBy(*key, value, "_island").agg(F.count("*").alias("n"), *[F.min(o).alias(f"first_{o}") for o in order])
    return out.where(F.col("n") >= least).drop("_island")


def distribution(df: DataFrame, value: Column, kinds: list[str]) -> DataFrame:
    """(kind, n, pct) for every kind in the given order, zeros included."""
    spark = df.sparkSession
    counts = df.select(value.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    every = spark.createDataFrame(list(enumerate(kinds)), "ord int, kind string")
    j = every.join(counts, "kind", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(W.partitionBy())
    return j.withColumn("pct", F.when(total > 0, F.round(100.0 * F.col("n") / total)).otherwise(0.0)).select("ord", "kind", "n", "pct")


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, heading, chars): text under each second-level heading; what comes before the first is left out."""
    from folioquarry.sources.records import lines

    each = lines(docs, text, key)
    head = F.col("content").rlike(r"^##\s+")
    n = F.sum(head.cast("int")).over(W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumn("section", n).where("section > 0")
    return each.groupBy(key, "section").agg(F.max(F.when(head, F.regexp_replace("content", r"^##\s+", ""))).alias("heading"), F.sum(F.when(head, 0).otherwise(F.length(X.no_space("content")))).alias("chars"))


def long_sentences(docs: DataFrame, key: str, text: str = "text", least: int = LONG_SENTENCE, most: int = LONGEST) -> DataFrame:
    each = docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence")).withColumn("length", F.length("sentence"))
    return each.where(F.col("length") >= least).orderBy(F.desc("length"), key, "pos").limit(most)


def quality(df: DataFrame) -> DataFrame:
    """df (of vocabulary, with_mattr and readability) with monotonous and too_complex."""
    return df.withColumns({"monotonous": (F.col("n_tokens") >= MONOTONOUS_TOKENS) & (F.col("mattr") <= MONOTONOUS), "too_complex": (F.col("sentences") >= COMPLEX_SENTENCES) & (F.col("label") == X.BANDS[-1][1])})


def report(df: DataFrame, totals: DataFrame, advice: DataFrame) -> DataFrame:
    """One JSON document: stats rows, totals and advice; for corpora whose report fits in a row."""
    as_list = lambda d, name: d.agg(F.collect_list(F.struct("*")).alias(name))
    return as_list(df, "stats").crossJoin(as_list(totals, "totals")).crossJoin(as_list(advice, "advice")).select(F.to_json(F.struct("*")).alias("report"))


def stale(docs: DataFrame, cached: DataFrame, key: str = "doc_id", text: str = "text", version: int = 1) -> DataFrame:
    """docs that a cache (key, digest, version) does not hold as they are now."""
    now = docs.withColumns({"digest": F.sha2(F.coalesce(F.col(text), F.lit("")), 256), "version": F.lit(version)})
    return now.join(cached.select(key, "digest", "version"), [key, "digest", "version"], "left_anti")

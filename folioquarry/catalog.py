"""Every registered query of the library proper, with its SQL where SQL can express it.

Each query applies operators of this package to whole tables; floats are rounded so that both engines agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions import documents as D
from folioquarry.functions import text as X
from folioquarry.operators import checks as C
from folioquarry.operators import dictionaries as S
from folioquarry.operators import metrics as M
from folioquarry.operators import terms as T
from folioquarry.plans import template
from folioquarry.plans.querystream import Engine, bind, parse
from folioquarry.session import table
from folioquarry.sources.records import html_titles, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Literal terms that the term queries look for.
TERMS = ["the", "and", "that", "tion", "der", "und", "les", "que", "License", "Apache", "token", "idiot"]
_SENT = "list_filter(list_transform(string_split_regex(text, '[。！？!?]+'), lambda s: regexp_replace(regexp_replace(s, '[\\r\\n]', '', 'g'), '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g')), lambda s: s <> '')"
_TOK = "list_filter(string_split_regex(regexp_replace(text, '[\\p{P}$+<=>^`|~]', ' ', 'g'), '[ \\t\\r\\n\\f\\x0B]+'), lambda t: t <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    names = set("region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split())
    keys = {"part": "p_", "orders": "o_", "customer": "c_", "supplier": "s_", "nation": "n_", "region": "r_", "lineitem": "l_"}
    order = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey"}
    return Engine(lambda n: table(spark, sf_dir, n) if n in names else None, order, keys)


def _round(df: DataFrame, n: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


# --- the pipe notation ---------------------------------------------------------


@query("SELECT * FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type IN ('ECONOMY', 'STANDARD') ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 5")
def qs_eq_in_sort_limit(spark, sf_dir):
    return _engine(spark, sf_dir).query("= parts | p_size=10..20 AND p_type=ECONOMY, STANDARD | -p_retailprice | 5")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P') OR o_orderstatus IS NULL")
def qs_neq(spark, sf_dir):
    return _engine(spark, sf_dir).query("= orders | o_orderstatus!=F, P").select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 12")
def qs_half_open_range(spark, sf_dir):
    return _engine(spark, sf_dir).query("= lineitem | l_quantity=10...12").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT 'gte' AS branch, c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 9000
UNION ALL SELECT 'lte', c_custkey, c_acctbal FROM customer WHERE c_acctbal <= -500
UNION ALL SELECT 'lt', c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0""")
def qs_open_ranges(spark, sf_dir):
    e, out = _engine(spark, sf_dir), None
    for branch, spec in (("gte", "9000.."), ("lte", "..-500"), ("lt", "...0")):
        part = e.query(f"= customers | c_acctbal={spec}").select(F.lit(branch).alias("branch"), "c_custkey", "c_acctbal")
        out = part if out is None else out.union(part)
    return out


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31'")
def qs_date_range(spark, sf_dir):
    return _engine(spark, sf_dir).query("= orders | o_orderdate=1997-03-01..1997-03-31").select("o_orderkey", "o_orderdate")


@query("SELECT * FROM nation WHERE n_name = 'NATION_7'")
def qs_key_lookup(spark, sf_dir):
    return _engine(spark, sf_dir).query("= nation | NATION_7")


@query("""SELECT 'any' AS match, p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'ring'])
UNION ALL SELECT 'all', p_partkey FROM part WHERE list_has_all(string_split(p_name, ' '), ['red', 'ring'])""")
def qs_multivalue(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
    either, both = bind(parse("= parts | tags=red, ring"), parts), bind(parse("= parts | tags=red && ring"), parts)
    return either.select(F.lit("any").alias("match"), "p_partkey").union(both.select(F.lit("all").alias("match"), "p_partkey"))


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice, o_orderkey LIMIT 20")
def qs_and_compare_asc(spark, sf_dir):
    return _engine(spark, sf_dir).query("= orders | o_orderstatus=F and o_totalprice>400000 && o_orderpriority=1-URGENT | +o_totalprice | 20").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("""SELECT n, s_name, concat_ws(chr(10), CASE WHEN n = 1 THEN '| name | balance |' END, CASE WHEN n = 1 THEN '|---|---|' END,
  '| ' || s_name || ' | ' || CAST(s_suppkey AS VARCHAR) || ' |', CASE WHEN s_acctbal_text <> '' THEN 'balance ' || s_acctbal_text END) AS rendered
FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, *, CASE WHEN s_acctbal > 0 THEN CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) ELSE '' END AS s_acctbal_text FROM supplier)""")
def qs_render_rows(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumn("s_acctbal_text", F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal").cast("string")).otherwise(""))
    text = "| name | balance |\n|---|---|\n| {s_name} | {s_suppkey} |\nbalance {s_acctbal_text}"
    return template.render_rows(df, text, "s_suppkey").select("n", "s_name", "rendered")


# --- document metrics -----------------------------------------------------------


@query(f"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(regexp_replace(text, '[\\r\\n]', '', 'g')) AS BIGINT) AS chars_no_newline,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS lines,
  CAST(len(s) AS BIGINT) AS sentences, round(CASE WHEN len(s) > 0 THEN list_sum(list_transform(s, lambda x: length(x))) / len(s) ELSE 0 END, 6) AS avg_sentence,
  CAST(len(regexp_extract_all(text, '[,、，]')) AS BIGINT) AS commas FROM (SELECT *, {_SENT} AS s FROM documents)""")
def doc_basic_stats(spark, sf_dir):
    df = M.basic_stats(table(spark, sf_dir, "documents"))
    return _round(df, 6, "avg_sentence").select("doc_id", "chars", "chars_no_newline", "lines", "sentences", "avg_sentence", "commas")


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS alpha_chars, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS BIGINT) AS alpha_runs,
  CAST(len(regexp_extract_all(text, '\\p{Han}')) AS BIGINT) AS kanji_chars FROM documents""")
def doc_char_classes(spark, sf_dir):
    return M.char_classes(table(spark, sf_dir, "documents")).select("doc_id", "alpha_chars", "alpha_runs", "kanji_chars")


_FEATURES = """SELECT *, list_filter(list_transform(string_split_regex(text, '[。！？!?]+'), lambda s: regexp_replace(s, '[ \\t\\r\\n\\f\\x0B]', '', 'g')), lambda s: s <> '') AS s,
  len(regexp_extract_all(text, '[A-Za-z]')) AS ac, len(regexp_extract_all(text, '[A-Za-z]+')) AS ar, len(regexp_extract_all(text, '、')) AS cm, len(regexp_extract_all(text, '。')) AS pc,
  len(regexp_extract_all(text, '\\p{Hiragana}')) AS hc, len(regexp_extract_all(text, '\\p{Hiragana}+')) AS hr, len(regexp_extract_all(text, '\\p{Han}')) AS kc, len(regexp_extract_all(text, '\\p{Han}+')) AS kr,
  len(regexp_extract_all(text, '[\\p{Katakana}ー]')) AS tc, len(regexp_extract_all(text, '[\\p{Katakana}ー]+')) AS tr FROM documents"""


def _score_sql(total: str, n: str, of=lambda c: c) -> str:
    """Commas count by full stops; a mean of nothing is 0."""
    mean = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    terms = [(-0.12, mean(total, n)), (-1.37, mean(of("ac"), of("ar"))), (7.4, mean(of("hc"), of("hr"))), (-23.18, mean(of("kc"), of("kr"))), (-5.4, mean(of("tc"), of("tr"))), (-4.67, mean(of("cm"), of("pc")))]
    return "115.79" + "".join(f" + ({w}) * ({x})" for w, x in terms)


_CHARS = "coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)"


@query(f"""SELECT doc_id, score, CASE WHEN score >= 60 THEN 'Easy' WHEN score >= 40 THEN 'Standard' ELSE 'Professional' END AS label
FROM (SELECT doc_id, round({_score_sql(_CHARS, "len(s)")}, 2) AS score FROM ({_FEATURES}))""")
def doc_readability(spark, sf_dir):
    df = _round(M.readability(table(spark, sf_dir, "documents")), 2, "score")
    return df.withColumn("label", X.readability_label(F.col("score"))).select("doc_id", "score", "label")


@query(f"""SELECT lang, CAST(sum(len(s)) AS BIGINT) AS sentences, round({_score_sql(f"sum({_CHARS})", "sum(len(s))", lambda c: f"sum({c})")}, 2) AS score
FROM ({_FEATURES}) GROUP BY lang""")
def corpus_readability_by_lang(spark, sf_dir):
    return _round(M.corpus_readability(table(spark, sf_dir, "documents"), "lang"), 2, "score").select("lang", "sentences", "score")


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_unique,
  round(CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END, 6) AS ttr,
  round(CASE WHEN len(t) > 0 THEN list_sum(list_transform(t, lambda x: length(x))) / len(t) ELSE 0 END, 6) AS avg_word FROM (SELECT *, {_TOK} AS t FROM documents)""")
def doc_vocabulary(spark, sf_dir):
    return _round(M.vocabulary(table(spark, sf_dir, "documents")), 6, "ttr", "avg_word").select("doc_id", "n_tokens", "n_unique", "ttr", "avg_word")


@query(f"""WITH w AS (SELECT doc_id, {_TOK} AS t FROM documents),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM w),
g AS (SELECT *, lag(pos) OVER (PARTITION BY doc_id, token ORDER BY pos) AS before FROM e),
-- an occurrence adds a type to each window that holds it but not the occurrence before it
c AS (SELECT doc_id, n, CASE WHEN n <= 100 THEN CASE WHEN before IS NULL THEN 1 ELSE 0 END
  ELSE greatest(0, least(pos, n - 99) - greatest(1, pos - 99, coalesce(before, 0) + 1) + 1) END AS adds FROM g)
SELECT w.doc_id, round(coalesce(CASE WHEN max(c.n) <= 100 THEN sum(adds) / max(c.n) ELSE sum(adds) / (max(c.n) - 99) / 100 END, 0), 6) AS mattr
FROM w LEFT JOIN c USING (doc_id) GROUP BY w.doc_id""")
def doc_mattr(spark, sf_dir):
    return _round(M.with_mattr(M.vocabulary(table(spark, sf_dir, "documents"))), 6, "mattr").select("doc_id", "mattr")


@query(f"""SELECT lang, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(DISTINCT token) AS BIGINT) AS n_unique
FROM (SELECT lang, unnest({_TOK}) AS token FROM documents) GROUP BY lang""")
def corpus_vocabulary(spark, sf_dir):
    return M.corpus_vocabulary(table(spark, sf_dir, "documents"), "lang").select("lang", "n_tokens", "n_unique")


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({_TOK}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 15")
def token_top_k(spark, sf_dir):
    return M.top(M.token_counts(table(spark, sf_dir, "documents")), M.TOP_WORDS, "n", "token")


@query("""WITH m AS (SELECT round(median(n_chars) * 0.65) AS low, round(median(n_chars) * 1.5) AS high FROM documents)
SELECT doc_id, n_chars, CASE WHEN n_chars < low THEN 'too short' WHEN n_chars > high THEN 'too long' END AS volume_class FROM documents, m""")
def volume_class(spark, sf_dir):
    return M.volume_classes(table(spark, sf_dir, "documents"), "n_chars").select("doc_id", "n_chars", "volume_class")


@query("""WITH s AS (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents GROUP BY source),
j AS (SELECT source, doc_id, n_chars, CASE WHEN n_chars >= m + d THEN 'high' WHEN n_chars <= m - d THEN 'low' END AS side FROM documents JOIN s USING (source) WHERE d > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source, side ORDER BY CASE WHEN side = 'high' THEN -n_chars ELSE n_chars END, doc_id) AS rank FROM j WHERE side IS NOT NULL)
SELECT source, side, CAST(rank AS INTEGER) AS rank, doc_id, n_chars FROM r WHERE rank <= 3""")
def outlier_docs(spark, sf_dir):
    return M.outliers(table(spark, sf_dir, "documents"), ["source"], "n_chars", "doc_id")


@query("""WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, min(ts) AS first_ts, min(event_id) AS first_event_id FROM r GROUP BY user_id, event_type, g HAVING count(*) >= 2""")
def event_runs(spark, sf_dir):
    return M.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2)


_ISLANDS = """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber {extra} FROM lineitem),
f AS (SELECT *, CASE WHEN l_linenumber = lag(l_linenumber) OVER w + 1 {same} THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber {order})),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber {order} ROWS UNBOUNDED PRECEDING) AS g FROM f)"""


@query(_ISLANDS.format(extra="", same="", order="") + """, r AS (SELECT l_orderkey, g, min(l_linenumber) AS first, max(l_linenumber) AS last FROM g GROUP BY l_orderkey, g)
SELECT l_orderkey, string_agg(CASE WHEN first = last THEN CAST(first AS VARCHAR) ELSE first || '-' || last END, ', ' ORDER BY first) AS pages FROM r GROUP BY l_orderkey""")
def page_ranges(spark, sf_dir):
    return T.range_text(T.page_ranges(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber"), ["l_orderkey"])


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT *, CASE WHEN l_linenumber = lag(l_linenumber) OVER w + 1 AND flag = lag(flag) OVER w THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS g FROM f),
z AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, g) AS size FROM g)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY l_orderkey, g, CASE WHEN size < 3 THEN l_linenumber END""")
def constrained_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    return T.page_ranges(d, ["l_orderkey"], "l_linenumber", ["flag"], T.MIN_RANGE)


_POLITE = "ませんでした でしょう ましょう ですか ますか でした ました ません ます です".split()
_PLAIN = "であった である だった だ".split()
_ENDS = lambda words: " OR ".join(f"suffix(b, '{w}')" for w in words)


@query(f"""WITH s AS (SELECT doc_id, unnest({_SENT}) AS x FROM documents),
b AS (SELECT regexp_replace(regexp_replace(x, '[。．！？!?]+$', ''), '[ \t\r\n\f\x0B]+$', '') AS b FROM s),
k AS (SELECT CASE WHEN b = '' THEN 'その他' WHEN {_ENDS(_POLITE)} THEN 'です・ます' WHEN {_ENDS(_PLAIN)} THEN 'だ・である' WHEN regexp_matches(b, '[\\p{{Han}}\\p{{Katakana}}A-Za-z0-9ー]$') THEN '体言止め' ELSE 'その他' END AS kind FROM b),
e AS (SELECT * FROM (VALUES (0, 'です・ます'), (1, '体言止め'), (2, 'だ・である'), (3, 'その他')) v(ord, kind))
SELECT ord, kind, CAST(count(k.kind) AS BIGINT) AS n, round(100.0 * count(k.kind) / (SELECT count(*) FROM k)) AS pct FROM e LEFT JOIN k USING (kind) GROUP BY ord, kind""")
def ending_distribution(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.explode(X.sentences(F.col("text"))).alias("sentence"))
    return M.distribution(s, X.ending_class(X.sentence_ending("sentence")), list(X.ENDING_CLASSES))


# --- terms -----------------------------------------------------------------------

_TERM_ROWS = "(VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") t(term)"
_COUNTED = f"SELECT doc_id, source, term, (length(text) - length(replace(text, term, ''))) // length(term) AS tf FROM documents, {_TERM_ROWS} WHERE contains(text, term)"


@query(f"""SELECT term, CAST(sum(tf) AS BIGINT) AS tf, CAST(count(*) AS BIGINT) AS df, round((1 + ln(sum(tf))) * (ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1) * 30, 6) AS score
FROM ({_COUNTED}) GROUP BY term""")
def term_tfidf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _round(T.tfidf(T.count_terms(docs, TERMS), docs.count()), 6, "score")


_TERM = "[^ \\t\\r\\n\\f\\x0B。、！？…「」『』（）()\\[\\]{}#*|`>~:：;；,，\\\\]{2,20}"
_DEFINING = (f"({_TERM})とは[、,]?[^。]*(?:である|です|を意味|を指|という)", f"({_TERM})(?:について|に関して)(?:は|の)", f"({_TERM})(?:を|が)(?:定義|説明|解説)", f"「({_TERM})」(?:とは|は|について)", f"({_TERM})(?:の概念|の定義|の意味)")
_FOUND = " UNION ALL ".join(f"SELECT '{trait}' AS trait, unnest(regexp_extract_all(text, '{p}', 1)) AS term FROM documents" for trait, ps in (("technical", ("([ァ-ヶー]{3,})", "([A-Z][a-zA-Z]{2,})", "([A-Z]{2,})")), ("definition", _DEFINING)) for p in ps)
_VALID = "length(term) >= 2 AND NOT regexp_matches(term, '(?i)^(?:span|div|class|id|data-|href|src)$') AND NOT regexp_matches(term, '[。、！？#*|`>~\\[\\]()（）「」『』【】\\r\\n\\t]|:::|^[\\s\\-.:：]|[\\s\\-.:：]$')"


@query(f"""SELECT term, CAST(sum(CASE trait WHEN 'technical' THEN 15 ELSE 30 END) AS BIGINT) AS bonus FROM (SELECT DISTINCT term, trait FROM ({_FOUND}) WHERE {_VALID}) GROUP BY term""")
def term_traits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return T.trait_bonus(T.extract(docs, T.TECHNICAL, "technical").union(T.extract(docs, T.DEFINITIONS, "definition", sign=T.DEFINING)))


@query(f"""WITH p AS (SELECT DISTINCT source, term FROM ({_COUNTED})), n AS (SELECT count(DISTINCT source) AS total FROM documents)
SELECT term, CAST(count(*) AS BIGINT) AS groups, round(count(*) / max(total), 6) AS ratio, max(total) >= 6 AND count(*) >= 3 AND count(*) / max(total) >= 0.5 AS common FROM p, n GROUP BY term""")
def term_spread(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _round(T.spread(T.count_terms(docs.where("source IS NOT NULL"), TERMS, "source"), docs.select("source").distinct().count(), "source"), 6, "ratio")


@query(f"""WITH c AS (SELECT token AS term, CAST(count(*) AS DOUBLE) AS cs FROM (SELECT unnest({_TOK}) AS token FROM documents WHERE lang = 'en') GROUP BY token),
r AS (SELECT token AS term, CAST(count(*) AS DOUBLE) AS rs, length(token) = 3 AS manual FROM (SELECT unnest({_TOK}) AS token FROM documents WHERE lang <> 'en') GROUP BY token HAVING count(*) >= 20),
j AS (SELECT coalesce(c.term, r.term) AS term, coalesce(cs, rs, 0) AS score, r.term IS NOT NULL AS registered, coalesce(manual, false) AS manual FROM c FULL JOIN r ON c.term = r.term),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS rank FROM j)
SELECT term, score, CAST(CASE WHEN rank <= 300 THEN rank END AS INTEGER) AS rank, CASE WHEN registered AND (manual OR rank <= 100) THEN 'kept' WHEN registered THEN 'review' WHEN rank <= 100 THEN 'recommended' WHEN rank <= 300 THEN 'general' ELSE 'hidden' END AS band FROM k""")
def ranking_bands(spark, sf_dir):
    """Candidates are the words of English texts, registered terms the frequent words of all other texts."""
    docs = table(spark, sf_dir, "documents")
    score = F.col("n").cast("double").alias("score")
    c = M.token_counts(docs.where("lang = 'en'")).select(F.col("token").alias("term"), score)
    r = M.token_counts(docs.where("lang <> 'en'")).where("n >= 20").select(F.col("token").alias("term"), score, (F.length("token") == 3).alias("manual"))
    return T.ranking_bands(r, c, 100)


@query("""WITH s AS (SELECT list_sort(list(n_chars)) AS s, count(*) AS n FROM documents), r AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS ratio)
SELECT CAST(ratio AS DOUBLE) AS ratio, s[CASE WHEN ratio = 1 THEN n ELSE least(CAST(floor(n * ratio) AS BIGINT), n - 1) + 1 END] AS value FROM s, r""")
def score_quantiles(spark, sf_dir):
    return T.score_quantiles(table(spark, sf_dir, "documents"), "n_chars")


@query("""WITH t AS (SELECT * FROM (VALUES ('the'), ('and'), ('der'), ('que'), ('les')) t(term)),
h AS (SELECT term, page_id, len(string_split(h, term)) - 1 AS h1, len(string_split(replace(html, h, ''), term)) - 1 AS body FROM (SELECT page_id, html, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS h FROM pages), t),
s AS (SELECT term, page_id, CAST(3 * h1 + body AS BIGINT) AS score, sum(h1 + body) OVER (PARTITION BY term) AS n, row_number() OVER (PARTITION BY term ORDER BY 3 * h1 + body DESC, page_id) AS k FROM h)
SELECT term, page_id, score FROM s WHERE k = 1 AND n >= 2""")
def main_reference(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("h", F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    pages = pages.withColumn("term", F.explode(F.array(*[F.lit(t) for t in ("the", "and", "der", "que", "les")])))
    n = lambda c: (F.length(c) - F.length(F.replace(c, F.col("term"), F.lit("")))) / F.length("term")
    rest = F.when(F.col("h") == "", F.col("html")).otherwise(F.replace("html", F.col("h"), F.lit("")))
    hits = pages.select("term", "page_id", n(F.col("h")).cast("long").alias("h1"), F.lit(0).alias("h2"), F.lit(0).alias("h3"), n(rest).cast("long").alias("body"))
    return T.main_reference(hits, "page_id")


@query("""WITH t AS (SELECT sum(n_chars) AS c, count(*) AS n FROM documents), g AS (SELECT *, pow(c / 50000.0, 0.749) AS g FROM t),
p AS (SELECT * FROM (VALUES ('light', 65, 90), ('standard', 120, 175), ('thorough', 225, 230)) p(preset, a, b))
SELECT preset, round(a * g) AS low, round(b * g) AS high, CASE WHEN n < round(a * g) THEN 'below by ' || CAST(CAST(round(a * g) - n AS BIGINT) AS VARCHAR) WHEN n > round(b * g) THEN 'above by ' || CAST(CAST(n - round(b * g) AS BIGINT) AS VARCHAR) ELSE 'within' END AS gap FROM g, p""")
def index_size_estimate(spark, sf_dir):
    t = table(spark, sf_dir, "documents").agg(F.sum("n_chars").alias("c"), F.count("*").alias("n"))
    sizes = F.array(*[F.struct(F.lit(k).alias("preset"), low.alias("low"), high.alias("high")) for k, (low, high) in T.index_size(F.col("c")).items()])
    return t.select("n", F.explode(sizes).alias("x")).select("x.preset", "x.low", "x.high", T.gap(F.col("n"), F.col("x.low"), F.col("x.high")).alias("gap"))


_POSTINGS = f"SELECT doc_id, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) - 1 AS pos FROM documents"
_TERMS_SQL = ", ".join(f"'{t}'" for t in TERMS)


@query(f"""SELECT term, doc_id, CAST(pos AS INTEGER) AS pos, CAST(o AS BIGINT) AS occurrence, o = 1 AS is_definition, 'idx-' || left(sha1(term), 12) || '-' || o AS anchor
FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id, pos) AS o FROM ({_POSTINGS}) WHERE term IN ({_TERMS_SQL}))""")
def postings_first_occurrence(spark, sf_dir):
    return T.number_occurrences(T.postings(table(spark, sf_dir, "documents"), TERMS))


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY term, doc_id ORDER BY pos) AS nth FROM ({_POSTINGS}) WHERE term IN ({_TERMS_SQL})),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN nth = 1 THEN 0 ELSE 1 END, doc_id, pos) AS k FROM p)
SELECT term, doc_id, CAST(pos AS INTEGER) AS pos, CAST(nth AS INTEGER) AS nth FROM r WHERE k <= 8""")
def coverage_top_k(spark, sf_dir):
    return T.coverage_top(T.postings(table(spark, sf_dir, "documents"), TERMS))


@query("""WITH h AS (SELECT doc_id, text, strpos(text, 'License') AS hit, length(text) AS n, row_number() OVER (ORDER BY doc_id) AS k FROM documents WHERE contains(text, 'License'))
SELECT doc_id, trim(regexp_replace(substr(text, greatest(1, least(hit - 40, n - 87 + 1)), 87), '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g'), ' ') AS context FROM h WHERE k <= 3""")
def term_contexts(spark, sf_dir):
    return T.contexts(table(spark, sf_dir, "documents"), "License")


# --- checks ----------------------------------------------------------------------

_WORDS_SQL = """SELECT doc_id, line, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
  'https?://\\S+', ' ', 'g'), '\\S+@\\S+\\.\\S+', ' ', 'g'), '`[^`]*`', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&\\w+;', ' ', 'g'), '\\S*[/\\\\]\\S+', ' ', 'g'), '\\{[^}]*\\}', ' ', 'g'), '\\b\\w*\\d\\w*\\b', ' ', 'g'), '([a-zA-Z]+(?:-[a-zA-Z]+)*)', 1)) AS word
FROM (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents))"""
_DICT_SQL = "SELECT DISTINCT lower(unnest(regexp_extract_all(text, '([a-zA-Z]+)', 1))) AS key FROM benchmark"


def _dictionary(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+)"), 1)).alias("w")).select(F.lower("w").alias("key")).distinct()


@query(f"""SELECT lower(word) AS key, CAST(count(DISTINCT (doc_id, line)) AS BIGINT) AS n_lines FROM ({_WORDS_SQL}) WHERE length(word) >= 2 AND lower(word) NOT IN ({_DICT_SQL}) GROUP BY lower(word)""")
def spell_unknown(spark, sf_dir):
    return C.spelling_summary(C.unknown_words(C.words_of(table(spark, sf_dir, "documents"), "doc_id"), _dictionary(spark, sf_dir)), "doc_id")


@query("""WITH d AS (SELECT DISTINCT lower(p_type) AS key FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer UNION SELECT DISTINCT event_type FROM events),
u AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS key FROM part UNION SELECT DISTINCT lower(left(c_mktsegment, length(c_mktsegment) - 1)) FROM customer UNION SELECT DISTINCT event_type || 'x' FROM events),
n AS (SELECT u.key, d.key AS entry, levenshtein(u.key, d.key) AS distance FROM u, d WHERE u.key NOT IN (SELECT key FROM d)),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, entry) AS k FROM n WHERE distance <= CASE WHEN length(key) <= 4 THEN 1 WHEN length(key) <= 8 THEN 2 ELSE 3 END)
SELECT key, entry AS suggestion, CAST(distance AS INTEGER) AS distance FROM f WHERE k = 1""")
def spell_suggest(spark, sf_dir):
    one = lambda t, c: table(spark, sf_dir, t).select(c.alias("key"))
    market = F.lower("c_mktsegment")
    d = one("part", F.lower("p_type")).union(one("customer", market)).union(one("events", F.col("event_type"))).distinct().withColumn("ord", F.col("key"))
    u = one("part", F.explode(F.split(F.lower("p_name"), " "))).union(one("customer", F.expr("left(lower(c_mktsegment), length(c_mktsegment) - 1)"))).union(one("events", F.concat("event_type", F.lit("x")))).distinct()
    return C.suggestions(u.join(d, "key", "left_anti"), d)


@query("""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, target, CASE WHEN regexp_matches(target, '(?i)\\b(javascript|data|vbscript|file):') THEN 'dangerous' WHEN regexp_matches(target, '^https?://') THEN 'external' WHEN starts_with(target, '#') THEN 'anchor' ELSE 'internal' END AS kind
FROM (SELECT page_id, unnest(l) AS target, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def link_inventory(spark, sf_dir):
    return C.links(table(spark, sf_dir, "pages"), "page_id")


_PATHS = "SELECT '/' || token AS id, min(page_id) AS page_id FROM (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<h1>(.*?)</h1>', 1), '([^ ]+)', 1)) AS token FROM pages) GROUP BY token"


@query(f"""WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS id FROM pages), t AS ({_PATHS})
SELECT 'resolved' AS state, id, CAST(count(*) AS BIGINT) AS n FROM r WHERE id IN (SELECT id FROM t) GROUP BY id
UNION ALL SELECT 'undefined', id, CAST(count(*) AS BIGINT) FROM r WHERE id NOT IN (SELECT id FROM t) GROUP BY id
UNION ALL SELECT 'orphans', id, CAST(1 AS BIGINT) FROM t WHERE id NOT IN (SELECT id FROM r)""")
def reference_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    refs = C.links(pages, "page_id").select("page_id", F.col("target").alias("id"))
    words = F.regexp_extract_all(F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit("([^ ]+)"), 1)
    targets = pages.select("page_id", F.explode(words).alias("w")).groupBy("w").agg(F.min("page_id").alias("page_id")).select(F.concat(F.lit("/"), "w").alias("id"), "page_id")
    got, out = C.resolve(refs, targets), None
    for state in ("resolved", "undefined", "orphans"):
        part = got[state].groupBy("id").agg(F.count("*").alias("n")).select(F.lit(state).alias("state"), "id", "n")
        out = part if out is None else out.union(part)
    return out


@query("""SELECT conv_id, turn, role, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1 THEN 'left' ELSE 'right' END AS side, CASE role WHEN 'user' THEN 'Reader' WHEN 'assistant' THEN 'Author' ELSE role END AS name FROM conversations""")
def dialogue_sides(spark, sf_dir):
    cast = spark.createDataFrame([("user", "Reader"), ("assistant", "Author")], "key string, name string")
    return C.dialogue(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", cast).select("conv_id", "turn", "role", "side", "name")


@query("""SELECT CAST(doc_id AS BIGINT) AS chapter, CAST(count(*) FILTER (WHERE n > 20) AS BIGINT) AS error, CAST(count(*) FILTER (WHERE n <= 20) AS BIGINT) AS warning, CAST(0 AS BIGINT) AS info
FROM (SELECT doc_id, (length(l) - length(replace(l, '!', ''))) AS n FROM (SELECT doc_id, unnest(string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10))) AS l FROM documents)) WHERE n > 0 GROUP BY doc_id""")
def issue_summary(spark, sf_dir):
    each = lines(table(spark, sf_dir, "documents"), "text", "doc_id").withColumn("n", F.regexp_count("content", F.lit("!"))).where("n > 0")
    found = C.issues(each.where("n > 20"), "doc_id", F.col("line"), "error", "marks", F.lit("far too many")).union(C.issues(each.where("n <= 20"), "doc_id", F.col("line"), "warning", "marks", F.lit("exclamation")))
    return C.issue_counts(found)


@query("""SELECT page_id, CASE WHEN trim(t) <> '' THEN trim(t) ELSE url END AS title FROM (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)""")
def page_titles(spark, sf_dir):
    return html_titles(table(spark, sf_dir, "pages")).select("page_id", "title")


# --- dictionaries and scalar functions ------------------------------------------------


@query("""SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS k FROM customer) WHERE k = 1""")
def first_by_key(spark, sf_dir):
    return S.first_by(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], ["c_acctbal", "c_custkey"]).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("""SELECT coalesce(a.term, b.term) AS term, coalesce(b.reading, a.reading) AS reading, CASE WHEN a.term IS NOT NULL AND b.term IS NOT NULL THEN 'ig' WHEN a.term IS NOT NULL THEN 'i' ELSE 'g' END AS flags, coalesce(b.definition, a.definition) AS definition
FROM (SELECT p_name AS term, min(p_brand) AS reading, CAST(min(p_size) AS VARCHAR) AS definition FROM part WHERE p_size < 12 GROUP BY 1) a
FULL JOIN (SELECT p_name AS term, min(p_type) AS reading, CAST(max(p_size) AS VARCHAR) AS definition FROM part WHERE p_size > 45 GROUP BY 1) b ON a.term = b.term""")
def dictionary_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_size < 12").groupBy(F.col("p_name").alias("term")).agg(F.min("p_brand").alias("reading"), F.min("p_size").cast("string").alias("definition")).withColumn("flags", F.lit("i"))
    b = p.where("p_size > 45").groupBy(F.col("p_name").alias("term")).agg(F.min("p_type").alias("reading"), F.max("p_size").cast("string").alias("definition")).withColumn("flags", F.lit("g"))
    return S.merge_terms(a, b)


@query("SELECT p_name, p_brand, n FROM (SELECT p_name, min(p_brand) AS p_brand, CAST(count(*) AS BIGINT) AS n, count(DISTINCT p_brand) AS v FROM (SELECT p_name || ' ' || p_size || ' ' || p_type AS p_name, p_brand FROM part) GROUP BY p_name) WHERE v = 1")
def functional_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_size", "p_type").alias("p_name"), "p_brand")
    return S.functional(p, "p_name", "p_brand")


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[ \\t\\r\\n\\f\\x0B]+', '-', 'g'), '[^\\p{L}\\p{N}-]', '', 'g') AS slug,
  replace(replace(replace(replace(replace('<' || p_name || '> & "' || p_type || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  CASE WHEN p_size % 100 = 0 THEN 'preface' WHEN p_size % 100 BETWEEN 1 AND 89 THEN 'chapter' WHEN p_size % 100 BETWEEN 90 AND 98 THEN 'appendix' ELSE 'postface' END AS kind,
  round(p_size * 25.4 / 72, 6) AS mm FROM part""")
def scalar_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    html = F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_type", F.lit('"'))
    return p.select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), X.escape_html(html).alias("html"), X.chapter_kind(F.col("p_size") % 100).alias("kind"), F.round(X.to_mm(F.concat("p_size", F.lit("pt"))), 6).alias("mm"))


@query("""SELECT event_type, user_id, max_value FROM (SELECT user_id, event_type, max(value) AS max_value, row_number() OVER (PARTITION BY event_type ORDER BY max(value) DESC, user_id) AS k FROM events GROUP BY user_id, event_type) WHERE k <= 3""")
def top_per_group(spark, sf_dir):
    agg = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("max_value"))
    k = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("max_value"), "user_id"))
    return agg.withColumn("k", k).where("k <= 3").select("event_type", "user_id", "max_value")


@query()
def doc_structure(spark, sf_dir):
    """Sequential document functions (sentences with places, containers, width); SQL cannot express the state machines."""
    docs = table(spark, sf_dir, "documents")
    s = D.rows_of(D.located_sentences, F.col("text"))
    return docs.select("doc_id", F.size(s).alias("located"), F.size(D.rows_of(D.container_faults, F.col("text"))).alias("faults"), D.display_width_col(F.col("text")).alias("width"))

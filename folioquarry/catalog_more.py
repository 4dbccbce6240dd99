"""More registered queries with their SQL: the index workflow, prose and layout, numbering, dictionaries.

Notation that the driver's tables do not hold is put together from their columns, over whole tables; the SQL then says
from the columns what the operators must find in the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioquarry.catalog import _TOK, query
from folioquarry.functions import text as X
from folioquarry.operators import checks as C
from folioquarry.operators import dictionaries as S
from folioquarry.operators import guards as G
from folioquarry.operators import indexing as I
from folioquarry.operators import layout as L
from folioquarry.operators import metrics as M
from folioquarry.operators import terms as T
from folioquarry.session import table
from folioquarry.sources.records import expand_numbers, lines


def _tokens(spark, sf_dir, name: str, *keep: str):
    return table(spark, sf_dir, name).select(*keep, F.explode(X.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term"))


# --- index workflow -----------------------------------------------------------------------

_CAND = f"SELECT DISTINCT unnest({_TOK}) AS term FROM documents"
_REG = f"SELECT unnest({_TOK}) FROM benchmark"
_REJ = f"SELECT unnest({_TOK}) FROM conversations"


@query(f"""SELECT term, CASE WHEN term IN ({_REJ}) THEN 'rejected' ELSE 'selectable' END AS state FROM ({_CAND}) WHERE term NOT IN ({_REG})""")
def selectable_candidates(spark, sf_dir):
    own = lambda n: _tokens(spark, sf_dir, n).distinct()
    return I.selectable_states(own("documents"), own("benchmark"), own("conversations"))


@query(f"""SELECT c.term, coalesce(r.reading, c.term) AS reading FROM ({_CAND}) c LEFT JOIN (SELECT term, min(lang || ':' || term) AS reading FROM (SELECT lang, unnest({_TOK}) AS term FROM documents WHERE source = 'src0') GROUP BY term) r ON c.term = r.term
WHERE NOT regexp_matches(c.term, '^[''"]?#[0-9a-fA-F]{{3,8}}[''"]?$|^[0-9]+$')""")
def candidate_readings(spark, sf_dir):
    known = _tokens(spark, sf_dir, "documents", "lang", "source").where("source = 'src0'").select("term", F.concat_ws(":", "lang", "term").alias("reading"))
    return I.with_readings(_tokens(spark, sf_dir, "documents").distinct(), known)


@query("""SELECT p_partkey AS term, coalesce(CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END, s) AS score FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS s FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey""")
def rejected_scores(spark, sf_dir):
    rejected = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("term"), F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("score"))
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("term")).agg(F.sum("l_quantity").cast("double").alias("score"))
    return I.fill_scores(rejected, scores)


@query("""WITH s AS (SELECT l_partkey AS term, count(DISTINCT l_linenumber) AS g FROM lineitem GROUP BY 1), n AS (SELECT count(DISTINCT l_linenumber) AS n FROM lineitem)
SELECT term, g AS groups, round(g / n, 6) AS ratio FROM s, n WHERE g / n >= 0.33 AND term NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def wide_terms_without_main(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("term"), "l_linenumber")
    spread = T.spread(line, line.select("l_linenumber").distinct().count(), "l_linenumber")
    out = I.wide_without_main(spread, table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("term")))
    return out.select("term", "groups", F.round("ratio", 6).alias("ratio"))


def _marked(spark, sf_dir):
    """Markup by hand around columns of part: a term with a reading, one without, a unit, a note, a link, code and bars."""
    text = F.concat(F.lit("see ["), "p_name", F.lit("|"), "p_type", F.lit("] and ["), "p_brand", F.lit("], [Hz], ^[note] [x](y) [^1] `["), "p_brand", F.lit("z]` [https://u] [||]"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query("""WITH t AS (SELECT p_name AS term, p_type AS reading, p_partkey AS doc_id, 0 AS kind FROM part UNION ALL SELECT p_brand, p_brand, p_partkey, 1 FROM part UNION ALL SELECT '||', '||', p_partkey, 2 FROM part)
SELECT term, reading, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id, kind, reading) AS k FROM t) WHERE k = 1""")
def manual_terms(spark, sf_dir):
    return I.manual_terms(_marked(spark, sf_dir))


@query("SELECT 'Hz' AS term, min(p_partkey) AS first, CAST(count(*) AS BIGINT) AS documents FROM part")
def short_manual_terms(spark, sf_dir):
    return I.short_terms(_marked(spark, sf_dir))


_REVIEW = """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ig' WHEN 1 THEN 'i' WHEN 2 THEN 'r' ELSE '' END AS flags, p_size % 4 = 0 AND p_size % 3 = 0 AS q,
  CASE WHEN p_size % 4 < 2 THEN [CAST(p_size AS VARCHAR), CAST(p_size + 1 AS VARCHAR)] END AS main, p_name AS term, p_type AS yomi, CASE p_size % 3 WHEN 0 THEN 'NEW!' WHEN 1 THEN 'Today' END AS label,
  CASE WHEN p_size % 5 > 0 THEN p_size + 0.5 END AS score FROM part"""


@query(f"""SELECT p_partkey, flags, array_to_string(main, '+') AS main, q AS suggested, term, yomi, label, CAST(score AS DOUBLE) AS score,
  '- [' || flags || CASE WHEN main IS NULL THEN '' ELSE 'm' || CASE WHEN q THEN '?' ELSE '' END || array_to_string(main, ',') END || ']' || coalesce(' `' || label || '`', '') || ' **' || term || '** (' || yomi || ')' || coalesce(' - スコア: ' || CAST(CAST(score AS DOUBLE) AS VARCHAR), '') AS line FROM ({_REVIEW})""")
def review_lines(spark, sf_dir):
    """Lines are built from columns and parsed back."""
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 4 == 0, "ig").when(size % 4 == 1, "i").when(size % 4 == 2, "r").otherwise("").alias("f"), ((size % 4 == 0) & (size % 3 == 0)).alias("q"), F.when(size % 4 < 2, F.array(size.cast("string"), (size + 1).cast("string"))).alias("m"), F.col("p_name"), F.col("p_type"), F.when(size % 3 == 0, "NEW!").when(size % 3 == 1, "Today").alias("l"), F.when(size % 5 > 0, size.cast("double") + 0.5).alias("s"))
    p = p.select("p_partkey", I.review_line(F.col("f"), F.col("m"), F.col("q"), F.col("l"), F.col("p_name"), F.col("p_type"), F.col("s")).alias("line"))
    return I.review_lines(p, "line").withColumn("main", F.array_join("main", "+"))


@query("""SELECT o_orderkey, label, row_number() OVER (ORDER BY CASE label WHEN 'NEW!' THEN 0 WHEN 'Today' THEN 1 ELSE 2 END, chapter, o_orderkey) AS n FROM (SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority END, 'zzz') AS chapter,
  CASE WHEN o_orderstatus = 'P' THEN 'NEW!' WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'Today' END AS label FROM orders)""")
def review_order(spark, sf_dir):
    from folioquarry.operators.numbering import numbered

    o = table(spark, sf_dir, "orders").withColumn("label", I.review_label(F.col("o_orderstatus") == "P", F.col("o_orderdate"), F.lit("1998-01-01 15:00:00").cast("timestamp")))
    o = o.select("label", *I.review_order(F.col("label"), F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")), F.col("o_orderkey")))
    return numbered(o, "priority", "chapter", "o_orderkey", name="n").select("o_orderkey", "label", "n")


@query("SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS chapter, CASE WHEN n_regionkey % 2 = 0 THEN n_name || '/' || n_regionkey ELSE '' END AS path FROM nation")
def main_paths(spark, sf_dir):
    value = F.when(F.col("n_regionkey") % 2 == 0, F.concat_ws("#", "n_nationkey", F.concat(F.lit(" "), "n_name", F.lit(" ")), F.lit(""), "n_regionkey")).otherwise(F.col("n_nationkey").cast("string"))
    chapter, path = I.main_path(value)
    return table(spark, sf_dir, "nation").select("n_nationkey", chapter.alias("chapter"), F.array_join(path, "/").alias("path"))


@query("SELECT coalesce(CAST(user_id AS VARCHAR), 'unknown') AS chapter, coalesce(event_type, '') AS context, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def distinct_contexts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chapter"), F.col("event_type").alias("context"), "event_id")
    return I.distinct_contexts(e, order=["event_id"])


_VALIDITY = "(SELECT DISTINCT unnest(string_split(html, ' ')) AS term FROM pages UNION SELECT DISTINCT unnest(string_split(p_name || ' ' || p_size || ' ' || p_size || '% #' || lpad(CAST(p_size AS VARCHAR), 6, '0') || ' width=' || p_size || ' id', ' ')) FROM part)"


@query(f"""SELECT term, length(term) >= 2 AND NOT regexp_matches(term, '[。、！？#*|`>~\\[\\]()（）「」『』【】\\r\\n\\t]|:::|^[\\s\\-.:：]|[\\s\\-.:：]$') AND NOT contains(term, '<') AND NOT regexp_matches(term, '(?i)^(?:span|div|class|id|data-|href|src)$')
  AND NOT starts_with(term, '{{') AND NOT suffix(term, '}}') AND NOT regexp_matches(term, '^(?:width|height|align)=|^[0-9]+%$|^[="./:;,-]+$|^(?:yomi|index-term|idx-)') AS valid,
  term = '' OR starts_with(term, '**') OR suffix(term, '**') OR regexp_matches(term, '^[''"]?#[0-9a-fA-F]{{3,8}}[''"]?$|^[''"]?#[0-9a-fA-F]{{3,8}}[''"]?,\\s*[''"]?#|^[0-9]+$') AS garbage FROM {_VALIDITY}""")
def term_validity(spark, sf_dir):
    size = F.col("p_size").cast("string")
    made = F.concat("p_name", F.lit(" "), size, F.lit(" "), size, F.lit("% #"), F.lpad(size, 6, "0"), F.lit(" width="), size, F.lit(" id"))
    words = table(spark, sf_dir, "pages").select(F.explode(F.split("html", " ", -1)).alias("term")).union(table(spark, sf_dir, "part").select(F.explode(F.split(made, " ", -1)))).distinct()
    return words.select("term", T.valid_term("term").alias("valid"), T.garbage_term("term").alias("garbage"))


@query("SELECT p_name, row_number() OVER (ORDER BY length(p_name) DESC, ord) AS n FROM (SELECT p_name, min(p_partkey) AS ord FROM part GROUP BY p_name)")
def longest_first(spark, sf_dir):
    from folioquarry.operators.numbering import numbered

    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord")).withColumn("less", -F.length("p_name"))
    return numbered(p, "less", "ord", name="n").select("p_name", "n")


@query("SELECT count(*) AS entry_count, CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) AS link_count FROM part")
def link_totals(spark, sf_dir):
    return I.link_totals(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("links")))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def unscanned_chapters(spark, sf_dir):
    return I.unscanned(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS lo, l_linenumber * 10 + CAST(l_quantity AS BIGINT) % 10 AS hi FROM lineitem), h AS (SELECT l_orderkey, l_partkey AS term, (l_partkey + l_linenumber) % 80 AS line FROM lineitem)
SELECT DISTINCT h.l_orderkey, h.term, h.line FROM h JOIN r ON h.l_orderkey = r.l_orderkey AND h.line BETWEEN r.lo AND r.hi""")
def hits_in_sections(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    ranges = line.select("l_orderkey", (F.col("l_linenumber") * 10).alias("low"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long") % 10).alias("high")).distinct()
    hits = line.select("l_orderkey", F.col("l_partkey").alias("term"), ((F.col("l_partkey") + F.col("l_linenumber")) % 80).alias("line"))
    return I.within_ranges(hits, ranges, ["l_orderkey"])


@query("SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_landing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return I.first_landing(e, ["user_id", "event_type"], "ts")


@query("""SELECT p_partkey, '= ' || p_name || ' see [' || p_type || '] end' AS plain, p_name || p_type || replace(p_brand, ' ', '') AS heading FROM (SELECT p_partkey, replace(p_name, ' ', '') AS p_name, p_type, p_brand FROM part)""")
def sanitised_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("")))
    text = F.concat(F.lit("= "), "p_name", F.lit("<b class='x'>\n:::{.note}\n{width=20%} `code` see ["), "p_type", F.lit("](https://x/y)\n\n end"))
    heading = F.concat(F.lit("**"), "p_name", F.lit("** `"), "p_type", F.lit("` [ "), "p_brand", F.lit("|yomi] "))
    return p.select("p_partkey", I.sanitised(text).alias("plain"), I.heading_key(heading).alias("heading"))


# --- prose and layout -----------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, string_split({text}, chr(10)) AS l FROM documents)"
_FRONTED = "CASE WHEN doc_id % 2 = 0 THEN '---' ELSE 'x' END || chr(10) || lang || chr(10) || '---' || chr(10) || 'body ' || n_chars"


@query(f"""WITH e AS ({_LINES.format(text=_FRONTED)}) SELECT doc_id, line, content, doc_id % 2 = 0 AND line <= 3 AS front FROM e""")
def front_matter_lines(spark, sf_dir):
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, "---").otherwise("x"), F.lit("\n"), "lang", F.lit("\n---\nbody "), F.col("n_chars").cast("string"))
    each = lines(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "text", "doc_id")
    return L.front_matter(each, "doc_id").select("doc_id", "line", "content", "front")


_PAR = """WITH e AS (SELECT doc_id, line, trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) AS body FROM (SELECT doc_id, unnest(l) AS content, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, string_split(CASE WHEN suffix(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents))),
n AS (SELECT *, CASE WHEN body = '' OR regexp_matches(body, '^[ \\t]*(?:[-*+][ \\t]|[0-9]+[.)][ \\t]|\\||#+[ \\t]|>)') OR line = 1 OR lag(body) OVER w = '' THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
p AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM n)"""


@query(_PAR + " SELECT doc_id, min(line) AS start, max(line) AS stop, CAST(sum(length(body)) AS BIGINT) AS chars, md5(string_agg(body, '' ORDER BY line)) AS digest FROM p WHERE body <> '' GROUP BY doc_id, p")
def paragraphs(spark, sf_dir):
    p = L.paragraphs(lines(table(spark, sf_dir, "documents"), "text", "doc_id"), "doc_id")
    return p.select("doc_id", "start", "stop", F.length("text").cast("long").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(_PAR + """, o AS (SELECT doc_id, p, line, sum(length(body)) OVER (PARTITION BY doc_id, p ORDER BY line) - length(body) AS off, sum(length(body)) OVER (PARTITION BY doc_id, p) AS size FROM p WHERE body <> '')
SELECT doc_id, min(line) AS start, max(CASE WHEN off <= size // 2 THEN line END) AS middle FROM o GROUP BY doc_id, p""")
def line_of_offset(spark, sf_dir):
    """The line that holds the middle of each paragraph: an as-of look-up of an offset among the starts of lines."""
    p = L.paragraphs(lines(table(spark, sf_dir, "documents"), "text", "doc_id"), "doc_id")
    return p.select("doc_id", "start", L.line_at(F.col("places"), F.floor(F.length("text") / 2).cast("int")).alias("middle"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'と同じように' WHEN 1 THEN NULL WHEN 2 THEN 'と同様に' WHEN 3 THEN NULL ELSE 'と同じく' END AS comparison FROM part""")
def ambiguous_comparisons(spark, sf_dir):
    k = F.col("p_size") % 5
    tail = F.when(k == 0, "と同じように動かない。").when(k == 1, "と同じように少ない。").when(k == 2, "と同様に見えません。").when(k == 3, "ない、と同様に動く。").otherwise("と同じく動くと同様に共有せずに")
    return table(spark, sf_dir, "part").select("p_partkey", L.ambiguous_comparison(F.concat("p_name", tail)).alias("comparison"))


@query("SELECT p_partkey, p_name || repeat(' ', 8 + length(p_type)) || p_brand || chr(10) || repeat(' ', 4) || chr(10) || repeat(' ', 5) || '.' AS text FROM part")
def blanked_comments(spark, sf_dir):
    text = F.concat("p_name", F.lit("<!-- "), "p_type", F.lit("-->"), "p_brand", F.lit("\n<!--\n a-->."))
    return table(spark, sf_dir, "part").select("p_partkey", L.blank_comments(text).alias("text"))


_STRAY = """WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber * 2 AS line, l_returnflag AS f FROM lineitem), d AS (SELECT l_orderkey, line, min(f) AS f FROM t GROUP BY 1, 2),
n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) * 2 - 1 AS line, f, lead(f) OVER (PARTITION BY l_orderkey ORDER BY line) AS nf FROM d)
SELECT l_orderkey, line, CASE WHEN nf IS NULL THEN 'trailing' ELSE 'before_heading' END AS kind, CASE WHEN nf = 'R' THEN '### head' END AS heading FROM n WHERE f = 'A' AND (nf IS NULL OR nf = 'R')"""


@query(_STRAY)
def stray_breaks(spark, sf_dir):
    """A text for each order: a break, a body line or a heading for each of its lines, with empty lines between."""
    flag = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    line = F.when(F.col("f") == "A", "***").when(F.col("f") == "R", "### head").otherwise("body")
    docs = flag.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    return L.stray_breaks(docs, "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN chr(CAST(65 + l_orderkey % 26 AS INTEGER)) || '-' || k WHEN 1 THEN l_orderkey || '-' || k ELSE CAST(k AS VARCHAR) END AS number
FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))""")
def section_numbers(spark, sf_dir):
    heads = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    kind = F.col("l_orderkey") % 3
    return L.section_numbers(heads, "l_orderkey", "l_linenumber", F.when(kind == 1, F.col("l_orderkey")), F.when(kind == 0, F.chr(65 + F.col("l_orderkey") % 26)))


@query("""SELECT r_name AS title, row_number() OVER (ORDER BY r_regionkey) AS number, first_chapter FROM (SELECT r_regionkey, r_name, min(n_nationkey) AS first_chapter FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 2 GROUP BY 1, 2)""")
def part_numbers(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 2").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("chapters"))
    parts = table(spark, sf_dir, "region").join(n, "r_regionkey", "left").withColumn("chapters", F.coalesce("chapters", F.array().cast("array<bigint>")))
    return L.part_numbers(parts, "r_name", "r_regionkey", "chapters").select(F.col("r_name").alias("title"), "number", "first_chapter")


@query("""SELECT user_id, event_type AS note, row_number() OVER (PARTITION BY user_id ORDER BY f) AS number FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2)""")
def footnote_numbers(spark, sf_dir):
    return L.footnote_numbers(table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("note")), "user_id", "event_id")


@query("""SELECT p_partkey, 'Part' || p_size || '_' || p_name AS safe, CASE WHEN p_size % 2 = 0 THEN '(&%)' ELSE '(%)' END AS signs FROM part""")
def safe_file_names(spark, sf_dir):
    name = F.concat(F.lit(" Part("), "p_size", F.when(F.col("p_size") % 2 == 0, "&").otherwise(""), F.lit("%)__"), "p_name", F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", L.safe_name(name).alias("safe"), F.array_join(L.unsafe_signs(name), "").alias("signs"))


_BASIC = """SELECT lang, length(text) AS chars, len(regexp_extract_all(text, '[,、，]')) AS commas,
  list_filter(list_transform(string_split_regex(text, '[。！？!?]+'), lambda s: regexp_replace(regexp_replace(s, '[\\r\\n]', '', 'g'), '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g')), lambda s: s <> '') AS s FROM documents"""


@query(f"""SELECT lang, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(len(s)) AS BIGINT) AS sentences, CAST(sum(commas) AS BIGINT) AS commas, round(sum(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)) / sum(len(s)), 4) AS avg_sentence FROM ({_BASIC}) GROUP BY lang""")
def corpus_basic_stats(spark, sf_dir):
    out = L.corpus_basic(M.basic_stats(table(spark, sf_dir, "documents")), "lang")
    return out.select("lang", "chars", "sentences", "commas", F.round("avg_sentence", 4).alias("avg_sentence"))


@query("""SELECT doc_id, unnest([1, 2]) AS section, unnest(['a', lang]) AS heading, unnest([n, 4]) AS chars, unnest([CASE WHEN n < 400 THEN 'too short' WHEN n > 4000 THEN 'too long' END, 'too short']) AS warning
FROM (SELECT doc_id, lang, CAST(length(regexp_replace(text, '[ \\t\\r\\n\\f\\x0B]', '', 'g')) AS BIGINT) AS n FROM documents WHERE NOT regexp_matches(text, '(?m)^##\\s') AND lang IS NOT NULL)""")
def section_volumes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?m)^##\s") & F.col("lang").isNotNull())
    d = d.select("doc_id", F.concat(F.lit("intro\n## a\n"), "text", F.lit("\n## "), "lang", F.lit("\nlast\n")).alias("text"))
    return L.section_warnings(M.sections(d, "doc_id")).select("doc_id", F.col("section").cast("int").alias("section"), "heading", "chars", "warning")


@query("SELECT count(*) AS chapters, CAST(sum(n_chars) AS BIGINT) AS total, CAST(round(avg(n_chars)) AS BIGINT) AS average FROM documents")
def chapter_counts(spark, sf_dir):
    return L.chapter_summary(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT doc_id FROM documents WHERE n_chars > 2000 OR lang = 'en'")
def visible_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    warnings = F.filter(F.array(F.when(F.col("n_chars") > 2000, "long"), F.when(F.col("lang") == "en", "english")), lambda x: x.isNotNull())
    return L.visible(d.select("doc_id", warnings.alias("warnings"))).select("doc_id")


@query()
def kanji_levels(spark, sf_dir):
    """Levels of characters made from part keys; the code table behind them is not in SQL."""
    d = table(spark, sf_dir, "part").select(F.decode(F.unhex(F.hex(F.encode(F.format_string("%c", (F.col("p_partkey") % 20000 + 19968).cast("int")), "UTF-8"))), "UTF-8").alias("text"))
    return L.kanji_counts(d)


@query("""WITH c AS (SELECT p_type AS char, count(*) AS n FROM part GROUP BY 1 ORDER BY n, char LIMIT 15), p AS (SELECT DISTINCT p_type AS char, p_size, p_partkey FROM part)
SELECT char, n, CAST(k AS INTEGER) AS nth, p_size, p_partkey FROM (SELECT p.*, n, row_number() OVER (PARTITION BY p.char ORDER BY p_size, p_partkey) AS k FROM p JOIN c ON p.char = c.char) WHERE k <= 5""")
def rarest_with_places(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("char"), "p_size", "p_partkey")
    return L.rarest(p.groupBy("char").agg(F.count("*").alias("n")), p)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 THEN regexp_replace(CAST(o_orderkey AS VARCHAR), '([0-9]+)([0-9]{3})$', '\\1,\\2') ELSE CAST(o_orderkey AS VARCHAR) END AS shown,
  'v1 &lt;&#36;2&gt; @versions ' || o_orderstatus AS macros FROM orders WHERE o_orderkey < 1000000""")
def shown_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey < 1000000")
    text = F.concat(F.lit("@version @title @versions "), "o_orderstatus")
    return o.select("o_orderkey", L.thousands(F.col("o_orderkey")).alias("shown"), L.value_macros(text, {"version": "v1", "title": "<$2>"}).alias("macros"))


# --- dictionaries, checks and labels ----------------------------------------------------------


@query("SELECT p_name AS term, replace(flags, 'i', '') AS flags FROM (SELECT DISTINCT p_name, CASE WHEN p_name LIKE '%a%' THEN 'ig' ELSE 'g' END AS flags FROM part) WHERE p_name = 'x' OR flags <> ''")
def flags_without_index(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.when(F.col("p_name").contains("a"), "ig").otherwise("g").alias("flags")).distinct()
    return p.withColumn("flags", F.translate("flags", "i", "")).where("flags <> ''")


@query("""SELECT c_custkey AS term, c_name AS reading FROM customer UNION ALL SELECT term, reading FROM (SELECT o_custkey AS term, min(o_orderpriority) AS reading FROM orders GROUP BY 1) WHERE term NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT -s_suppkey, min(s_name) FROM supplier WHERE -s_suppkey NOT IN (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) GROUP BY 1""")
def insert_if_absent(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("term"), F.col("c_name").alias("reading"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("term"), F.col("o_orderpriority").alias("reading")).union(table(spark, sf_dir, "supplier").select(-F.col("s_suppkey"), "s_name"))
    return S.insert_absent(old, new)


@query(f"""WITH b AS (SELECT unnest({_TOK}) AS word, 0 AS o FROM benchmark UNION ALL SELECT unnest({_TOK}), 1 FROM documents)
SELECT word FROM (SELECT word, row_number() OVER (PARTITION BY lower(word) ORDER BY o, word) AS k FROM b) WHERE k = 1""")
def united_words(spark, sf_dir):
    word = lambda n: _tokens(spark, sf_dir, n).select(F.col("term").alias("word"))
    return S.upsert_words(word("benchmark"), word("documents"))


@query("""WITH h AS (SELECT DISTINCT p_size, unnest([p_type, left(p_type, 4), p_brand]) AS hit FROM part)
SELECT p_size, hit FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.p_size = b.p_size AND length(b.hit) > length(a.hit) AND contains(b.hit, a.hit))""")
def longest_hits(spark, sf_dir):
    h = table(spark, sf_dir, "part").select("p_size", F.explode(F.array("p_type", F.substring("p_type", 1, 4), "p_brand")).alias("hit")).distinct()
    return C.drop_subsumed(h, ["p_size"], "hit")


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0)")
def orphan_files(spark, sf_dir):
    listing = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("basename")).distinct()
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").cast("string").alias("basename"))
    return C.orphan_files(listing, known).select(F.col("basename").cast("long").alias("o_custkey"))


@query("""SELECT coalesce(r, d) AS id, CASE WHEN r IS NULL THEN 'unused' WHEN d IS NULL THEN 'missing' ELSE 'ok' END AS state FROM (SELECT DISTINCT l_partkey AS r FROM lineitem WHERE l_quantity > 25) FULL JOIN (SELECT p_partkey AS d FROM part WHERE p_size < 30) ON r = d""")
def footnote_states(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("id"))
    return C.footnotes(refs, table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("id")))


@query(f"""SELECT term, CAST(count(*) AS BIGINT) AS total, string_agg(doc_id || ':' || pos, ' ' ORDER BY doc_id, pos) AS places FROM (SELECT doc_id, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) - 1 AS pos FROM documents) WHERE term IN ('Apache', 'GNU', 'MIT', 'License') GROUP BY term""")
def inverted_index(spark, sf_dir):
    index = T.inverted_index(T.postings(table(spark, sf_dir, "documents"), ["Apache", "GNU", "MIT", "License"]))
    return index.select("term", "total", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["pos"])), " ").alias("places"))


@query("""SELECT rule, label, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(line AS VARCHAR), ', ' ORDER BY line) FILTER (WHERE k <= 10) || CASE WHEN count(*) > 10 THEN ' …' ELSE '' END AS lines
FROM (SELECT p_type AS rule, p_brand AS label, p_size AS line, count(*) AS n, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size) AS k FROM part GROUP BY 1, 2, 3) GROUP BY rule, label""")
def findings_by_rule(spark, sf_dir):
    return C.findings_summary(table(spark, sf_dir, "part").select(F.col("p_type").alias("rule"), F.col("p_brand").alias("label"), F.col("p_size").alias("line")))


@query("SELECT p_name AS id, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_labels(spark, sf_dir):
    targets = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), "p_partkey")
    return C.resolve(targets.select("id").limit(0), targets)["duplicates"]


_LABELLED = "SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k, p_size, p_brand FROM part"


@query(f"""SELECT p_size, 'p' || p_partkey AS id, CAST(k * 2 - 1 AS INTEGER) AS line, p_brand AS title, CASE WHEN p_partkey % 2 = 0 THEN 'heading' ELSE 'caption' END AS kind,
  CAST(row_number() OVER (PARTITION BY p_size, p_partkey % 2 ORDER BY k) AS INTEGER) AS number FROM ({_LABELLED})""")
def label_numbers(spark, sf_dir):
    return C.labels(_labelled(spark, sf_dir), "p_size").select("p_size", "id", "line", "title", "kind", "number")


@query(f"SELECT p_size, CAST(k * 2 AS INTEGER) AS line, unnest(['p' || (p_partkey + 1), 'p' || p_partkey]) AS id FROM ({_LABELLED})")
def references_in_text(spark, sf_dir):
    return C.references(_labelled(spark, sf_dir), "p_size")


def _labelled(spark, sf_dir):
    """A text for each size: a heading or a caption with a label, then a line with two references and what is none."""
    key = F.col("p_partkey")
    label = F.when(key % 2 == 0, F.concat(F.lit("## "), "p_brand", F.lit(" @p"), key)).otherwise(F.concat(F.lit("** "), "p_brand", F.lit(" @p"), key, F.lit(" **")))
    line = F.concat(label, F.lit("\nsee @p"), key, F.lit(", @pageref:p"), key + 1, F.lit(", a@b, `@c`, [@d](https://e/@f), https://g/@h, @today"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("t")))), lambda x: x["t"])
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.array_join(rows, "\n").alias("text"))


@query("SELECT l_orderkey, l_returnflag, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem) WHERE k = 1")
def first_on_page(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    return T.keep_first_per_page(line, ["l_orderkey", "l_returnflag"], "l_linenumber")


@query("""SELECT p_partkey, CASE WHEN regexp_matches(left(p_name, 1), '[A-Za-z]') THEN upper(left(p_name, 1)) ELSE '?' END AS row, regexp_replace(regexp_replace(regexp_replace(lower(p_name || '--' || p_brand), '[^a-z0-9]+', '-', 'g'), '-{2,}', '-', 'g'), '^-|-$', '', 'g') AS slug,
  CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'ruby' WHEN 2 THEN 'xyz' ELSE 'text' END AS language FROM part""")
def names_and_languages(spark, sf_dir):
    k = F.col("p_size") % 4
    path = F.concat(F.lit("src/"), "p_brand", F.when(k == 0, ".py").when(k == 1, ".RB").when(k == 2, ".xyz").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.kana_row("p_name", "p_name").alias("row"), X.ascii_slug(F.concat_ws("--", "p_name", "p_brand")).alias("slug"), X.language_of(F.regexp_replace(path, r"#", "")).alias("language"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS n FROM nation WHERE n_nationkey BETWEEN 3 AND 7 OR n_nationkey IN (9, 12, 13, 14)")
def expanded_ranges(spark, sf_dir):
    wanted = expand_numbers([9, "3-5", "7-5", "12-14"])
    return table(spark, sf_dir, "nation").where(F.col("n_nationkey").isin(wanted)).select(F.col("n_nationkey").cast("int").alias("n"))


@query("""SELECT l_orderkey AS chapter, CAST(max(k) * 2 - 1 AS INTEGER) AS line, 'error' AS severity, 'fence' AS category, 'a code fence is not closed' AS message FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) GROUP BY l_orderkey HAVING count(*) % 2 = 1""")
def unclosed_fences(spark, sf_dir):
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", F.array_join(F.array_repeat(F.lit("```py"), F.col("n").cast("int")), "\nx = 1\n").alias("text"))
    return C.fence_issues(docs, "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber AS line, level, CAST(greatest(level - b, 0) AS INTEGER) AS opened, CAST(greatest(b - level, 0) AS INTEGER) AS closed FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) AS b FROM (SELECT l_orderkey, l_linenumber, CAST(min(l_quantity) AS INTEGER) % 3 + 1 AS level FROM lineitem GROUP BY 1, 2))""")
def contents_levels(spark, sf_dir):
    heads = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg((F.min("l_quantity").cast("int") % 3 + 1).alias("level"))
    return C.toc(heads, "l_orderkey")


@query("SELECT event_type, user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type NOT IN ('click') AND NOT regexp_matches(CAST(user_id AS VARCHAR), '7$') GROUP BY 1, 2")
def kept_findings(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.col("user_id").cast("string").alias("message"))
    kept = L.kept_findings(e, ["click"], ["7$"])
    return kept.groupBy(F.col("rule").alias("event_type"), F.col("message").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


# --- guards and imports ---------------------------------------------------------------------


def _sheets(spark, sf_dir):
    name = F.regexp_replace("p_name", " ", "-")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("/* .no */ p."), name, F.lit(" { content: '.nor' } ."), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("::after {}")).alias("css"))


@query("SELECT replace(p_name, ' ', '-') AS class FROM part UNION SELECT lower(replace(p_type, ' ', '_')) FROM part")
def css_classes(spark, sf_dir):
    return G.css_classes(_sheets(spark, sf_dir))


@query("""SELECT p_partkey, 2 AS line, lower(replace(p_type, ' ', '_')) || 'x' AS class, lower(replace(p_type, ' ', '_')) AS suggestion FROM part""")
def unknown_container_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("`:::{.code}`\n:::{."), F.regexp_replace("p_name", " ", "-"), F.lit(" ."), F.lower(F.regexp_replace("p_type", " ", "_")), F.lit("x}\ntext\n:::")).alias("text"))
    return G.unknown_classes(G.container_classes(docs, "p_partkey"), G.css_classes(_sheets(spark, sf_dir)), "p_partkey")


@query("SELECT 'f' || o_orderkey AS file, CAST(l_linenumber AS INTEGER) AS line, l_returnflag AS rule, l_linestatus AS message FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def lint_messages(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("ruleId"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_linestatus").alias("message"))).alias("messages"))
    each = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    bad = spark.createDataFrame([("no json",)], "report string")
    return G.lint_messages(each.select(F.to_json(F.array(F.struct(F.concat(F.lit("f"), "o_orderkey").alias("filePath"), "messages"))).alias("report")).union(bad))


@query("SELECT o_custkey AS basename, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) THEN 'ok' ELSE 'missing' END AS state FROM (SELECT DISTINCT o_custkey FROM orders)")
def catalog_entry_states(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("basename")).distinct()
    return G.entry_states(own, table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("basename")))


@query("""SELECT CASE kind WHEN 'preface' THEN 0 WHEN 'chapter' THEN 1 WHEN 'appendix' THEN 2 ELSE 3 END AS ord, kind, string_agg(s_name, ',' ORDER BY n, s_name) AS basenames FROM (SELECT s_suppkey % 100 AS n, s_name, CASE WHEN s_suppkey % 100 = 0 THEN 'preface' WHEN s_suppkey % 100 < 90 THEN 'chapter' WHEN s_suppkey % 100 < 99 THEN 'appendix' ELSE 'postface' END AS kind FROM supplier) GROUP BY kind""")
def rebuilt_catalog(spark, sf_dir):
    listing = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 100).alias("number"), F.col("s_name").alias("basename"))
    return G.rebuilt_catalog(listing).withColumn("basenames", F.array_join("basenames", ","))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'ch/' || p_partkey || '.png' WHEN p_partkey % 3 = 1 THEN 'data/images/' || p_partkey || '.webp' END AS resolved FROM part""")
def resolved_images(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    refs = p.select("p_partkey", F.concat(F.when(F.col("p_size") % 10 == 0, "https://x/").otherwise(""), key, F.lit(".png")).alias("src"))
    files = p.select(F.explode(F.array(F.when(key % 3 == 0, F.concat(F.lit("ch/"), key, F.lit(".png"))), F.when(key % 3 == 0, F.concat(F.lit("data/images/"), key, F.lit(".png"))), F.when(key % 3 == 1, F.concat(F.lit("data/images/"), key, F.lit(".webp"))))).alias("path")).where("path IS NOT NULL")
    return G.resolved_images(refs, files, [F.lit("ch"), F.lit("data/part"), F.lit("data/images")]).select("p_partkey", "resolved")


@query("""SELECT p_partkey, array_to_string(list_slice(l, CASE WHEN bad THEN 1 ELSE a END, CASE WHEN bad THEN len(l) ELSE least(z, len(l)) END), chr(10)) AS text FROM (SELECT p_partkey, l, a, z, a < 1 OR z < a OR a > len(l) AS bad
FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ') AS l, p_size % 6 AS a, p_size % 7 AS z FROM part))""")
def included_code(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("path"), F.translate(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ", "\n").alias("code"))
    refs = p.select(F.col("p_partkey").alias("path"), (F.col("p_size") % 6).alias("first"), (F.col("p_size") % 7).alias("last"))
    return G.included_code(refs, files).select(F.col("path").alias("p_partkey"), "text")


@query("""SELECT doc_id AS term, CASE WHEN n = 0 THEN 'error' ELSE 'warning' END AS severity, CAST(n AS INTEGER) AS length FROM (SELECT doc_id, length(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || source || repeat('x', CAST(n_chars AS INTEGER)) END, '[ \\t\\r\\n]', '', 'g')) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) WHERE n = 0 OR n > 400""")
def definition_issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    text = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("**"), "lang", F.lit("** ["), "source", F.lit("](u) `"), F.repeat(F.lit("x"), F.col("n_chars").cast("int")), F.lit("`")))
    return G.definition_issues(d.select(F.col("doc_id").alias("term"), F.regexp_replace(text, "`", "").alias("definition")), required=True)


@query("""SELECT term, manual FROM (SELECT unnest([p_name, CAST(p_size AS VARCHAR), '#' || lpad(CAST(p_size AS VARCHAR), 6, '0'), '<b>', '&&']) AS term, p_partkey % 2 = 0 AS manual FROM part) WHERE manual OR NOT regexp_matches(term, '^#?[0-9a-fA-F]{3,8}$|^[0-9\\s.,%]+$|^[=!<>&|+*/%^~-]+$|^</?[A-Za-z][^>]*>?$')""")
def shown_in_review(spark, sf_dir):
    size = F.col("p_size").cast("string")
    p = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", size, F.concat(F.lit("#"), F.lpad(size, 6, "0")), F.lit("<b>"), F.lit("&&"))).alias("term"), (F.col("p_partkey") % 2 == 0).alias("manual"))
    return G.shown_in_review(p)


@query("SELECT 's' || n_regionkey AS anchor, min(n_nationkey) AS n_nationkey FROM nation GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, n_nationkey FROM nation")
def anchor_pages(spark, sf_dir):
    html = F.concat(F.lit('<h1 id="s'), "n_regionkey", F.lit('">x</h1><p id="n'), "n_nationkey", F.lit('">'))
    return G.anchor_pages(table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), "n_nationkey")


@query("SELECT doc_id, replace(replace(text, 'the ', 'THE '), 'and ', '& ') AS text FROM documents")
def replaced_by_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", G.replaced(F.col("text"), [("the ", "THE "), ("and ", "& "), ("he ", "never"), ("nd ", "never")], ["he ", "nd "]).alias("text"))

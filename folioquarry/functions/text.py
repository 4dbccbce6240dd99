"""Column functions over text; all run in the JVM.

Patterns that an equivalent SQL needs as well are kept as text constants. White space is the ASCII class of the notation
(`[ \\t\\r\\n\\f\\x0B]`), not the Unicode one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n\f\x0B]"
SENTENCE_END = "[。！？!?]+"
CLAUSE_END = "、"
PUNCT = r"[\p{IsPunctuation}$+<=>^`|~]"
# The readability formula's weights and bands.
READ_BASE, READ_WEIGHTS = 115.79, {"ls": -0.12, "la": -1.37, "lh": 7.4, "lc": -23.18, "lk": -5.4, "cp": -4.67}
BANDS = ((60.0, "Easy"), (40.0, "Standard"), (None, "Professional"))
#: A text without such a letter has none of the last three classes.
JAPANESE = r"[\p{IsHiragana}\p{IsHan}\p{IsKatakana}ー]"
# Character classes whose runs readability counts.
CLASSES = {"alpha": "A-Za-z", "hiragana": r"\p{IsHiragana}", "kanji": r"\p{IsHan}", "katakana": r"\p{IsKatakana}ー"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), WS, "")


def line_count(c: Column | str) -> Column:
    """Lines; a trailing line feed begins none; an empty text has none."""
    c = _col(c)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, "\n", -1)) - F.when(c.endswith("\n"), 1).otherwise(0))


def sentences(c: Column | str) -> Column:
    parts = F.transform(F.split(_col(c), SENTENCE_END, -1), lambda s: F.regexp_replace(F.regexp_replace(s, r"[\r\n]", ""), rf"^{WS}+|{WS}+$", ""))
    return F.filter(parts, lambda s: s != "")


def clauses(c: Column | str) -> Column:
    parts = F.transform(F.split(_col(c), CLAUSE_END, -1), lambda s: F.regexp_replace(F.regexp_replace(s, r"[\r\n]", ""), rf"^{WS}+|{WS}+$", ""))
    return F.filter(parts, lambda s: s != "")


def total_length(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, s: a + F.length(s))


def safe_average(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def tokens(c: Column | str) -> Column:
    """Words of a text without a morphological dictionary: punctuation is space."""
    return F.filter(F.split(F.regexp_replace(_col(c), PUNCT, " "), rf"{WS}+", -1), lambda t: t != "")


def _class_count(c: Column, name: str, pattern: str) -> Column:
    n = F.regexp_count(c, F.lit(pattern))
    return n if name == "alpha" else F.when(c.rlike(JAPANESE), n).otherwise(0)


def class_runs(c: Column | str, name: str) -> Column:
    return _class_count(_col(c), name, f"[{CLASSES[name]}]+")


def class_chars(c: Column | str, name: str) -> Column:
    return _class_count(_col(c), name, f"[{CLASSES[name]}]")


def readability_features(c: Column | str) -> dict[str, Column]:
    """Twelve sums; add them over texts before scoring."""
    c = _col(c)
    parts = F.filter(F.transform(F.split(c, SENTENCE_END, -1), no_space), lambda s: s != "")
    out = {"sentences": F.size(parts).cast("long"), "sentence_chars": total_length(parts), "commas": F.regexp_count(c, F.lit("、")).cast("long")}
    for name in CLASSES:
        out[f"{name}_runs"] = class_runs(c, name).cast("long")
        out[f"{name}_chars"] = class_chars(c, name).cast("long")
    out["periods"] = F.regexp_count(c, F.lit("。")).cast("long")
    return out


def readability_score(prefix: str = "") -> Column:
    """The score from columns of feature sums; commas count by full stops, and a mean of nothing is 0."""
    f = lambda n: F.col(prefix + n)
    mean = {"ls": safe_average(f("sentence_chars"), f("sentences")), "cp": safe_average(f("commas"), f("periods"))}
    for key, name in (("la", "alpha"), ("lh", "hiragana"), ("lc", "kanji"), ("lk", "katakana")):
        mean[key] = safe_average(f(f"{name}_chars"), f(f"{name}_runs"))
    return F.lit(READ_BASE) + reduce(Column.__add__, [F.lit(w) * mean[k] for k, w in READ_WEIGHTS.items()])


def readability_label(score: Column) -> Column:
    (high, first), (low, second), (_, rest) = BANDS
    return F.when(score >= high, first).when(score >= low, second).when(score.isNotNull(), rest)


def strip_inline_code(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"`[^`\n]+`", " ")


def strip_markdown(c: Column | str) -> Column:
    """Prose of Markdown: headings, lists, quotes, images, links, emphasis, tags and rules without their marks."""
    steps = [(r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*(?:[-*+]|\d+\.)\s+", ""), (r"(?m)^\s*>+\s?", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(\*\*|__|\*|_)(.+?)\1", "$2"), (r"<[^>]+>", ""), (r"(?m)^\s*(?:[-*_]\s*){3,}$", "")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, _col(c))


def english_words(c: Column | str) -> Column:
    """Words a spelling check looks at: URLs, addresses, code, tags, paths, numbers and entities are left out."""
    junk = [r"https?://\S+", r"\S+@\S+\.\S+", r"`[^`]*`", r"<[^>]*>", r"&\w+;", r"\S*[/\\]\S+", r"\{[^}]*\}", r"(?<!\w)\w*\d\w*(?!\w)"]
    clean = reduce(lambda x, p: F.regexp_replace(x, p, " "), junk, _col(c))
    return F.filter(F.regexp_extract_all(clean, F.lit("([a-zA-Z]+(?:-[a-zA-Z]+)*)"), 1), lambda w: F.length(w) >= 2)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), rf"{WS}+", "-"), r"[^\p{L}\p{N}-]", "")


def ascii_slug(c: Column | str) -> Column:
    steps = [(r"[^a-z0-9]+", "-"), ("-{2,}", "-"), ("^-|-$", "")]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, F.lower(_col(c)))


def anchor_id(term: Column | str, n: Column) -> Column:
    return F.concat(F.lit("idx-"), F.substring(F.sha1(_col(term)), 1, 12), F.lit("-"), n.cast("string"))


def escape_html(c: Column | str) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), _col(c))


def to_hiragana(c: Column | str) -> Column:
    kata = "".join(chr(k) for k in range(0x30A1, 0x30F7))
    return F.translate(_col(c), kata, "".join(chr(ord(k) - 0x60) for k in kata))


# Rows of the kana table by their first character.
KANA_ROWS = {"あ": "[ぁ-おゔ]", "か": "[か-ごゕゖ]", "さ": "[さ-ぞ]", "た": "[た-ど]", "な": "[な-の]", "は": "[は-ぽ]", "ま": "[ま-も]", "や": "[ゃ-よ]", "ら": "[ら-ろ]", "わ": "[ゎ-ん]"}


def kana_row(reading: Column | str, term: Column | str) -> Column:
    """Where an index lists a term: symbols, digits and A to Z by the term, else the kana row of its reading."""
    first, y = F.substring(_col(term), 1, 1), F.substring(to_hiragana(reading), 1, 1)
    out = F.when(first.rlike("^[0-9]"), "0-9").when(first.rlike("^[A-Za-z]"), F.upper(first)).when(first.rlike(r"^[\x21-\x7E]"), "#")
    for name, pattern in KANA_ROWS.items():
        out = out.when(y.rlike(f"^{pattern}"), name)
    return out.otherwise("他")


def to_mm(c: Column | str) -> Column:
    """A length with a unit (mm, cm, in, pt, px, Q, em of 10 pt) in millimetres."""
    c = _col(c)
    n, unit = F.regexp_extract(c, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lower(F.regexp_extract(c, r"([A-Za-z]+)\s*$", 1))
    scale = {"mm": 1.0, "": 1.0, "cm": 10.0, "in": 25.4, "pt": 25.4 / 72, "px": 25.4 / 96, "q": 0.25, "em": 254 / 72}
    return n * reduce(lambda w, kv: w.when(unit == kv[0], F.lit(kv[1])), list(scale.items())[1:], F.when(unit == "mm", F.lit(1.0)))


def chapter_kind(n: Column | str) -> Column:
    n = _col(n)
    return F.when(n == 0, "preface").when(n.between(1, 89), "chapter").when(n.between(90, 98), "appendix").when(n == 99, "postface")


def volume_class(chars: Column | str, low: Column | float, high: Column | float) -> Column:
    chars = _col(chars)
    return F.when(chars < low, "too short").when(chars > high, "too long")


# Endings of the polite and the plain style, longest first, and the classes of a distribution in its order.
POLITE = ("ませんでした", "でしょう", "ましょう", "ですか", "ますか", "でした", "ました", "ません", "ます", "です")
PLAIN = ("であった", "である", "だった", "だ")
NOUN_END, OTHER_END = "体言止め", "その他"
ENDING_CLASSES = ("です・ます", NOUN_END, "だ・である", OTHER_END)


def sentence_ending(c: Column | str) -> Column:
    """How a sentence ends: one of the listed endings, a noun (its last character is no kana), or neither."""
    body = F.regexp_replace(F.regexp_replace(_col(c), r"[。．！？!?]+$", ""), rf"{WS}+$", "")
    kind = F.when(body == "", OTHER_END)
    for e in (*POLITE, *PLAIN):
        kind = kind.when(body.endswith(e), e)
    return kind.when(body.rlike(r"[\p{IsHan}\p{IsKatakana}A-Za-z0-9ー]$"), NOUN_END).otherwise(OTHER_END)


def ending_class(ending: Column) -> Column:
    return F.when(ending.isin(*POLITE), ENDING_CLASSES[0]).when(ending.isin(*PLAIN), ENDING_CLASSES[2]).when(ending == NOUN_END, NOUN_END).otherwise(OTHER_END)


def ending_label(ending: Column) -> Column:
    """How a run of endings is shown: with a full stop, a noun without."""
    return F.when(ending == NOUN_END, ending).otherwise(F.concat(ending, F.lit("。")))


def dice(a: Column | str, b: Column | str) -> Column:
    """Dice similarity of the multisets of characters."""
    a, b = F.split(_col(a), ""), F.split(_col(b), "")
    a, b = F.filter(a, lambda x: x != ""), F.filter(b, lambda x: x != "")
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    size = F.size(a) + F.size(b)
    return F.when(size > 0, 2.0 * common / size).otherwise(0.0)


def kwic(c: Column | str, at: Column, length: Column, width: int = 40) -> Column:
    """The context of a hit (1-based place): width characters on each side, what one side lacks goes to the other."""
    c = _col(c)
    n = F.length(c)
    want = length + 2 * width
    start = F.greatest(F.lit(1), F.least(at - width, n - want + 1))
    return F.trim(F.regexp_replace(F.substr(c, start, want), rf"{WS}+", " "))


# File extensions and their languages.
LANGUAGES = {"rb": "ruby", "py": "python", "js": "javascript", "ts": "typescript", "sh": "bash", "yml": "yaml", "yaml": "yaml", "json": "json", "html": "html", "css": "css", "md": "markdown", "c": "c", "rs": "rust", "go": "go", "java": "java", "sql": "sql"}


def language_of(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(_col(path), r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[ext], F.when(ext != "", ext), F.lit("text"))

"""Per-document functions that need sequential state: Arrow-batched, one document at a time."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^( {0,3}(?:> ?)*\s{0,3})(`{3,}|~{3,})(.*)$")


def code_lines(text: str) -> list[bool]:
    """Which lines are in fenced code, fences included: a fence is closed by one of its kind, as long, in as many quotes."""
    out, opened = [], None
    for line in text.split("\n"):
        m = _FENCE.match(line)
        quotes = m[1].count(">") if m else 0
        if opened is None:
            start = bool(m) and not (m[2][0] == "`" and "`" in m[3])
            out.append(start)
            opened = (m[2][0], len(m[2]), quotes) if start else None
        else:
            out.append(True)
            if m and m[2][0] == opened[0] and len(m[2]) >= opened[1] and quotes == opened[2] and not m[3].strip():
                opened = None
    return out


def strip_code(text: str) -> str:
    """Fenced lines made empty (their number stays), inline code one blank."""
    kept = ["" if code else re.sub(r"(`+)[^`\n]+?\1", " ", line) for line, code in zip(text.split("\n"), code_lines(text), strict=True)]
    return "\n".join(kept)


def protect_code(text: str) -> tuple[str, list[str]]:
    """The text with code spans and blocks as placeholders, and what they stand for."""
    held: list[str] = []

    def put(code: str) -> str:
        held.append(code)
        return f"\x00{len(held) - 1}\x00"

    out, block = [], []
    for line, code in zip(text.split("\n"), code_lines(text), strict=True):
        if code:
            block.append(line)
            continue
        if block:
            out.append(put("\n".join(block)))
            block = []
        out.append(re.sub(r"(`+)[^`\n]+?\1", lambda m: put(m[0]), line))
    if block:
        out.append(put("\n".join(block)))
    return "\n".join(out), held


def restore_code(text: str, held: list[str]) -> str:
    for k in range(len(held) - 1, -1, -1):
        text = text.replace(f"\x00{k}\x00", held[k])
    return text


def strip_emphasis(line: str) -> tuple[str, list[int]]:
    """The line without emphasis marks, and the place in the line of each character that stays."""
    at = list(range(len(line)))
    while m := re.search(r"(\*\*\*|\*\*|\*|___|__|(?<!\w)_(?=\S))(?=\S)(.+?)(?<=\S)\1", line):
        n = len(m[1])
        a, z = m.start(), m.end()
        at = at[:a] + at[a + n : z - n] + at[z:]
        line = line[:a] + m[2] + line[z:]
    return line, at


def mattr(words, window: int = 100) -> float:
    """Moving-average type-token ratio in one pass: counts of the window are kept up to date."""
    n = len(words)
    if not n:
        return 0.0
    if n <= window:
        return len(set(words)) / n
    counts: dict[str, int] = {}
    kinds = total = 0
    for i, w in enumerate(words):
        counts[w] = counts.get(w, 0) + 1
        kinds += counts[w] == 1
        if i >= window:
            old = words[i - window]
            counts[old] -= 1
            kinds -= counts[old] == 0
        if i >= window - 1:
            total += kinds
    return total / (n - window + 1) / window


def outline(text: str) -> list[dict]:
    """Headings outside code: line, level, text, ancestors, and the last line of their extent."""
    rows = text.split("\n")
    found, stack = [], []
    for n, (line, code) in enumerate(zip(rows, code_lines(text), strict=True), 1):
        m = None if code else re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if m:
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            found.append({"line": n, "level": level, "heading": m[2], "ancestors": [t for _, t in stack], "last": len(rows)})
            stack.append((level, m[2]))
    for k, h in enumerate(found):
        later = next((g["line"] for g in found[k + 1 :] if g["level"] <= h["level"]), None)
        h["last"] = later - 1 if later else h["last"]
    return found


def container_faults(text: str) -> list[dict]:
    """Unmatched ':::' containers outside code: line and fault (unclosed or surplus)."""
    out, stack = [], []
    for n, (line, code) in enumerate(zip(text.split("\n"), code_lines(text), strict=True), 1):
        m = None if code else re.match(r"\s*(:{3,})\s*(.*)$", line)
        if m and m[2].strip():
            stack.append(n)
        elif m and stack:
            stack.pop()
        elif m:
            out.append({"line": n, "fault": "surplus"})
    return sorted(out + [{"line": n, "fault": "unclosed"} for n in stack], key=lambda x: x["line"])


def located_sentences(text: str) -> list[dict]:
    """Sentences of prose across lines, with the line each begins on; blank and structural lines end what is open."""
    out, held, start = [], "", 0

    def close() -> None:
        nonlocal held
        if s := held.strip():
            out.append({"line": start, "sentence": s, "length": len(s)})
        held = ""

    for n, (line, code) in enumerate(zip(text.split("\n"), code_lines(text), strict=True), 1):
        if code or not line.strip() or re.match(r"\s*(?:#{1,6}\s|[-*+]\s|\d+\.\s|>|\||:::|!\[|<)", line):
            close()
            continue
        for part in re.findall(r"[^。！？!?]+[。！？!?]*|[。！？!?]+", line):
            if not held.strip():
                start = n
            held += part
            if re.search(r"[。！？!?]$", part):
                close()
    close()
    return out


def pipe_table(text: str) -> dict | None:
    """Header, body and alignments of a pipe table; an empty cell widens the one before it; '\\|' is a bar."""
    cells = lambda line: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\s*\||(?<!\\)\|\s*$", "", line))]
    rows = [r for r in text.strip().split("\n") if "|" in r]
    sep = next((k for k, r in enumerate(rows) if re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", r)), None)
    if sep is None:
        return None

    def spans(line: str) -> list[dict]:
        out: list[dict] = []
        for c in cells(line):
            if not c and out:
                out[-1]["colspan"] += 1
            else:
                out.append({"text": c, "colspan": 1})
        return out

    align = ["center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else None for c in cells(rows[sep])]
    return {"header": [spans(r) for r in rows[:sep]], "body": [spans(r) for r in rows[sep + 1 :]], "align": align}


def utterances(text: str) -> list[dict]:
    """Dialogue: 'Key: words' begins an utterance, indented lines go on with it."""
    out: list[dict] = []
    for line in text.split("\n"):
        m = re.match(r"([^\s:：][^:：]*?)\s*[:：]\s*(.*)$", line)
        if m and not line[:1].isspace():
            out.append({"speaker": m[1], "lines": [m[2]] if m[2] else []})
        elif out and line[:1].isspace() and line.strip():
            out[-1]["lines"].append(line.strip())
    return out


def display_width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def truncate(text: str, width: int) -> str:
    if display_width(text) <= width:
        return text
    out, used = "", 0
    for c in text:
        used += display_width(c)
        if used > width - 1:
            break
        out += c
    return out + "…"


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    hits_b = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hits_b[j] and b[j] == c:
                hits_b[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, h in zip(b, hits_b, strict=True) if h]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


def greedy_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Non-overlapping intervals: by start, the longest first."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, z))
    return out


def kanji_level(c: str) -> int:
    """2 for the first 47 rows of the basic set, 3 for its other rows, 4 for characters outside it."""
    try:
        raw = c.encode("euc_jp")
    except UnicodeEncodeError:
        return 4
    return 4 if len(raw) != 2 else 2 if raw[0] - 0xA0 <= 47 else 3


def _series(fn, kind):
    @F.pandas_udf(kind)
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fn(x) for x in col], dtype=object)

    return run


def strip_code_col(c):
    return _series(strip_code, T.StringType())(c)


def nfc(c):
    return _series(lambda x: unicodedata.normalize("NFC", x), T.StringType())(c)


def display_width_col(c):
    return _series(display_width, T.LongType())(c)


def mattr_col(c):
    """MATTR of an array of words."""
    return _series(lambda x: mattr(list(x)), T.DoubleType())(c)


_ROWS = {
    outline: "array<struct<line:int,level:int,heading:string,ancestors:array<string>,last:int>>",
    container_faults: "array<struct<line:int,fault:string>>",
    located_sentences: "array<struct<line:int,sentence:string,length:int>>",
    utterances: "array<struct<speaker:string,lines:array<string>>>",
    pipe_table: "struct<header:array<array<struct<text:string,colspan:int>>>,body:array<array<struct<text:string,colspan:int>>>,align:array<string>>",
}


def rows_of(fn, c):
    """The rows that one of outline, container_faults, located_sentences, utterances or pipe_table finds, as a column."""
    if _ROWS[fn].startswith("array"):
        return _series(fn, _ROWS[fn])(c)
    return F.try_element_at(_series(lambda x: [] if (row := fn(x)) is None else [row], f"array<{_ROWS[fn]}>")(c), F.lit(1))  # one struct

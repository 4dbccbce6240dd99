"""Small notations: list markers, phrases of a heading, broken lines, emoji, replacement rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

# Roman digits.
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman(text: str) -> int:
    total = top = 0
    for c in reversed(text.lower()):
        value = _ROMAN[c]
        total += value if value >= top else -value
        top = max(top, value)
    return total


def to_roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


@dataclass(frozen=True)
class Marker:
    indent: int
    style: str  # bullet, decimal, lower_roman, upper_roman, lower_alpha, upper_alpha
    start: int | None
    body: str


def list_marker(line: str) -> Marker | None:
    """The marker of a list line; single letters that are Roman digits are Roman; runs of other letters are no marker."""
    m = re.match(r"( *)(?:([-*+])|\((\w{1,9})\)|(\w{1,9})[.)])[ \t]+(\S.*)?$", line)
    if not m:
        return None
    token, indent, body = m[3] or m[4], len(m[1]), m[5] or ""
    if token is None:
        return Marker(indent, "bullet", None, body)
    if re.fullmatch("[0-9]+", token):
        return Marker(indent, "decimal", int(token), body)
    case = "lower" if token.islower() else "upper"
    if re.fullmatch("[ivxlcdm]+|[IVXLCDM]+", token):
        return Marker(indent, f"{case}_roman", roman(token), body)
    return Marker(indent, f"{case}_alpha", ord(token.lower()) - 96, body) if re.fullmatch("[A-Za-z]", token) else None


_CLOSING = re.compile(r"[ぁ-んー、。，．・：；？！）］｝」』〉》】〕”’]{1,2}")
_OPENING = re.compile(r"[（［｛「『〈《【〔“‘]+")


def phrases(text: str, words: Callable[[str], list[str]] | None = None) -> list[str]:
    """Units that a heading may be broken between; without a word splitter the whole text is one.

    Short kana and closing marks go with the word before, opening marks with the word after; the units join to the text.
    """
    parts = words(text) if words else []
    if "".join(parts) != text or not parts:
        return [text]
    out: list[str] = []
    opened = ""
    for w in parts:
        if _OPENING.fullmatch(w):
            opened += w
        elif out and not opened and _CLOSING.fullmatch(w):
            out[-1] += w
        else:
            out.append(opened + w)
            opened = ""
    if opened:
        out = [*out[:-1], out[-1] + opened] if out else [opened]
    return out


def keeps_break(line: str, after: str | None) -> bool:
    """Whether a line end of scanned text is one of the text's own, as far as the lines themselves tell."""
    a, b = line.strip(), (after or "").strip()
    if not a or not b or any(re.match(r"#{1,6}\s|第[0-9一二三四五六七八九十]+[章節]|[-*+・]\s|\d+[.)]\s", x) for x in (a, b)):
        return True
    if re.fullmatch(r"[、。，．！？!?」』）)]+", b) or re.match("[ぁぃぅぇぉっゃゅょァィゥェォッャュョー]", b):
        return False
    if re.search("[A-Za-z0-9]-?$", a) and re.match("[a-z0-9]", b):
        return False
    return True if re.search("[。！？!?」』）)]$", a) else re.search(r"[぀-ヿ一-鿿、，]$", a) is None


def merge_lines(text: str) -> str:
    lines, out = text.split("\n"), ""
    for k, line in enumerate(lines):
        after = lines[k + 1] if k + 1 < len(lines) else None
        out += line + ("" if after is None else "\n" if keeps_break(line, after) else "")
    return out


_EMOJI = re.compile("[\U0001f1e6-\U0001f1ff\U0001f300-\U0001faff☀-➿](?:️|‍[\U0001f300-\U0001faff☀-➿]|[\U0001f3fb-\U0001f3ff])*")


def emoji(text: str) -> list[tuple[int, str]]:
    """(place, code points joined by '-') of each emoji."""
    return [(m.start(), "-".join(f"{ord(c):x}" for c in m[0] if c != "️")) for m in _EMOJI.finditer(text)]


@dataclass(frozen=True)
class Rule:
    pattern: str
    put: str
    scope: str = "text"  # text: between tags only; all: tags too


def replace_html(html: str, rules: list[Rule]) -> str:
    """Applies the rules in order; text inside code and pre stays."""
    for r in rules:
        if r.scope == "all":
            html = re.sub(r.pattern, r.put, html)
            continue
        out, depth = [], 0
        for part in re.split(r"(<[^>]*>)", html):
            if m := re.match(r"<(/?)(code|pre)\b", part, re.I):
                depth += -1 if m[1] else 1
            out.append(part if part.startswith("<") or depth > 0 else re.sub(r.pattern, r.put, part))
        html = "".join(out)
    return html


def line_blocks(code: str) -> list[str]:
    """Highlighted code by lines, with the spans that are open at a line's end closed there and opened again."""
    out, opened = [], []
    for line in code.split("\n"):
        text = "".join(opened) + line
        for tag in re.findall(r"</?span\b[^>]*>", line):
            if tag.startswith("</"):
                if opened:
                    opened.pop()
            else:
                opened.append(tag)
        out.append(text + "</span>" * len(opened))
    return out


def deep_merge(default: dict, own: dict | None) -> dict:
    """Nested settings over their defaults; what is null stays at its default."""
    out = dict(default)
    for k, v in (own or {}).items():
        out[k] = deep_merge(default[k], v) if isinstance(v, dict) and isinstance(default.get(k), dict) else default.get(k) if v is None else v
    return out

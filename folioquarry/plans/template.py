"""Row templates compiled to one column expression.

A line with variables (``= key``, ``{key}`` or an image ``![alt](key)``) is repeated for each record and left out where a key
is missing or blank; a line without any stands once, before the first record. Records are set apart by an empty line.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquarry.operators.numbering import numbered
from folioquarry.plans.querystream import Engine, QueryError, parse

_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")
_FILE = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|avif)$", re.I)
_VARIABLE = re.compile(r"\{([A-Za-z_][\w.]*)\}|(?:(?<=^)|(?<=[\s|>*_(:]))=\s?([A-Za-z_][\w.]*)")


def _pieces(line: str) -> list[tuple[str, str]]:
    """(text or key, value) runs of a line."""
    spans = [(m.start(2), m.end(2), m[2]) for m in _IMAGE.finditer(line) if not _FILE.search(m[2]) and re.fullmatch(r"[A-Za-z_][\w.]*", m[2])]
    spans += [(m.start(), m.end(), m[1] or m[2]) for m in _VARIABLE.finditer(line)]
    out, at = [], 0
    for a, z, key in sorted(spans):
        if a >= at:
            out += [("text", line[at:a]), ("key", key)]
            at = z
    return [p for p in [*out, ("text", line[at:])] if p[1] or p[0] == "key"]


def keys(template: str) -> list[str]:
    return list(dict.fromkeys(v for line in template.split("\n") for kind, v in _pieces(line) if kind == "key"))


def check_keys(template: str, df: DataFrame) -> None:
    known = df.columns
    for key in keys(template):
        if key.split(".")[0] not in known:
            near = difflib.get_close_matches(key, known, 1)
            raise QueryError(f"no key {key}" + (f"; did you mean {near[0]}?" if near else ""))


def compile_lines(template: str, first: Column) -> Column:
    """The text of one record; `first` tells whether it is the first one."""
    out: list[Column] = []
    for line in template.rstrip("\n").split("\n"):
        parts = _pieces(line)
        held = [F.col(v).cast("string") for kind, v in parts if kind == "key"]
        if not line.strip():
            out.append(F.lit(""))
        elif not held:
            out.append(F.when(first, F.lit(line)))
        else:
            text = F.concat(*[F.lit(v) if kind == "text" else F.col(v).cast("string") for kind, v in parts])
            blank = F.lit(False)
            for c in held:
                blank = blank | c.isNull() | (F.trim(c) == "")
            out.append(F.when(~blank, text))
    return F.concat_ws("\n", *out)


def render_rows(df: DataFrame, template: str, *order: str) -> DataFrame:
    """df with n (1-based in the given order) and rendered; rows are numbered in ranges, not in one task."""
    check_keys(template, df)
    return numbered(df, *order, name="n").withColumn("rendered", compile_lines(template, F.col("n") == 1))


def render(df: DataFrame, template: str, *order: str) -> str:
    rows = render_rows(df, template, *order).orderBy("n").select("rendered").collect()
    return "\n\n".join(r["rendered"] for r in rows)


def expand(text: str, engine: Engine, templates: dict[str, str], order: str = "_ord", post_render: Callable[[str], str] | None = None) -> str:
    """Puts the rows of each query line of a text in its place; lines in code fences and failing lines stay as they are."""
    out, fence = [], None
    for number, line in enumerate(text.split("\n"), 1):
        m = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if m and (fence is None or (m[1][0] == fence[0] and len(m[1]) >= len(fence))):
            fence = m[1] if fence is None else None
        if fence is None and not m and re.match(r"=\s+\S", line):
            try:
                plan = parse(line)
                name, _ = engine.resolve(plan.source)
                df = engine.one(line) if plan.lookup else engine.query(line)
                chosen = templates.get(f"{name}.{plan.style}" if plan.style else name)
                if chosen is None:
                    raise QueryError(f"no template for {name}" + (f" in style {plan.style}" if plan.style else ""))
                line = "" if df is None else render(df, chosen, order)
                line = post_render(line) if post_render else line
            except QueryError as e:
                from folioquarry.plans.querystream import Issue

                engine.issues.append(Issue("error", "query", f"line {number}: {e}"))
        out.append(line)
    return "\n".join(out)

"""The pipe query notation:  = source | filters | sort | limit | :style

A line is parsed into a plan (immutable, no Spark); the plan is bound to a DataFrame by the DataFrame API alone, so filters
and the needed columns reach the scan and sort plus limit become one top-k. Segments may come in any order and be left out;
each is told by its shape. A singular source with a bare value is a key lookup.
"""

from __future__ import annotations

import datetime as dt
import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that a bare value is looked up in, by priority.
KEYS = ("id", "no", "code", "slug", "name", "title")

_NAME = r"[A-Za-z_][\w.]*"
_STYLE = re.compile(r":[\w.-]+")
_SORT = re.compile(rf"([+-])({_NAME})")
_AND = re.compile(r"\s+(?:AND|and|&&)\s+")
_CLAUSE = re.compile(rf"({_NAME})\s*(!=|>=|<=|=|>|<)\s*(.*)", re.S)
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


class QueryError(ValueError):
    """A line that cannot be parsed or bound."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str  # eq neq gt gte lt lte range
    value: object  # a list for eq and neq, (low, high, high is included) for range
    match: str = "any"  # of several eq values


@dataclass(frozen=True)
class Lookup:
    value: object
    fields: tuple[str, ...] = KEYS


@dataclass(frozen=True)
class Plan:
    source: str
    filters: tuple[Filter, ...] = ()
    sort: tuple[str, str] | None = None  # (field, asc or desc)
    limit: int | None = None
    style: str | None = None
    lookup: Lookup | None = None
    keys: dict = field(default_factory=dict, compare=False)


def literal(text: str) -> object:
    text = text.strip()
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d+\.\d+", text):
        return float(text)
    return text


def singular(word: str) -> str:
    """English singular of a table name, the part after a last underscore and trailing digits kept apart."""
    m = re.fullmatch(r"(.*?)((?:_?\d+)?)", word, re.S)
    stem, tail = m.groups()
    for pattern, put in ((r"ies$", "y"), (r"([sxz]|ch|sh)es$", r"\1"), (r"ves$", "f"), (r"(?<!s)s$", "")):
        if len(stem) > 2 and re.search(pattern, stem):
            return re.sub(pattern, put, stem) + tail
    return word


def _range(name: str, text: str) -> Filter | None:
    m = re.fullmatch(r"(.*?)(\.{2,3})(.*)", text.strip(), re.S)
    if not m or not (m[1].strip() or m[3].strip()):
        return None
    low, dots, high = m[1].strip(), m[2], m[3].strip()
    if not high:
        return Filter(name, "gte", literal(low))
    if not low:
        return Filter(name, "lt" if dots == "..." else "lte", literal(high))
    return Filter(name, "range", (literal(low), literal(high), dots == ".."))


def _values(text: str) -> list:
    return [literal(v) for v in text.split(",") if v.strip()]


def parse_filters(segment: str) -> list[Filter]:
    out: list[Filter] = []
    for clause in _AND.split(segment.strip()):
        m = _CLAUSE.fullmatch(clause.strip())
        if m is None:  # a bare value goes with the filter before it: all of them must match
            if not out or out[-1].op != "eq":
                raise QueryError(f"not a condition: {clause}")
            out[-1] = replace(out[-1], value=[*out[-1].value, *_values(clause)], match="all")
            continue
        name, op, text = m.groups()
        if not text.strip():
            raise QueryError(f"no value for {name}")
        if op == "=":
            out.append(_range(name, text) or Filter(name, "eq", _values(text)))
        elif op == "!=":
            out.append(Filter(name, "neq", _values(text)))
        else:
            out.append(Filter(name, {">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op], literal(text)))
    return out


def parse(line: str) -> Plan:
    """The plan of one query line, with or without the leading '='."""
    body = line.strip()
    body = body[1:].strip() if body.startswith("=") else body
    first, *rest = (s.strip() for s in body.split("|"))
    if not re.fullmatch(r"[\w./-]+", first):
        raise QueryError(f"no source: {line}")
    plan = Plan(first)
    single = singular(first) == first
    for k, s in enumerate(r for r in rest if r):
        if _STYLE.fullmatch(s):
            plan = replace(plan, style=s[1:])
        elif m := _SORT.fullmatch(s):
            plan = replace(plan, sort=(m[2], "desc" if m[1] == "-" else "asc"))
        elif re.search(r"[=!<>]", s) or _AND.search(s):
            plan = replace(plan, filters=plan.filters + tuple(parse_filters(s)))
        elif single and k == 0:
            plan = replace(plan, lookup=Lookup(literal(s)))
        elif re.fullmatch(r"\d+", s):
            plan = replace(plan, limit=int(s))
        else:
            plan = replace(plan, lookup=Lookup(literal(s)))
    return plan


def _type_of(df: DataFrame, name: str) -> T.DataType:
    kind: T.DataType = df.schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            near = difflib.get_close_matches(part, kind.names if isinstance(kind, T.StructType) else [], 1)
            raise QueryError(f"no column {name}" + (f"; did you mean {near[0]}?" if near else ""))
        kind = kind[part].dataType
    return kind


def _value(kind: T.DataType, v: object) -> Column:
    if isinstance(kind, (T.DateType, T.TimestampType)):
        text = str(v)
        try:
            dt.date.fromisoformat(text[:10])
        except ValueError:
            raise QueryError(f"not a date: {text}") from None
        return F.lit(text).cast(kind)
    return F.lit(v)


def _compare(c: Column, kind: T.DataType, v: object) -> tuple[Column, Column]:
    """Both sides of an ordering; dates held as strings compare as dates when the value is one."""
    if isinstance(kind, T.StringType):
        if isinstance(v, str) and _DATE.fullmatch(v):
            return F.coalesce(c.try_cast("date").cast("string"), c), F.lit(v)
        return (c.try_cast("double"), F.lit(float(v))) if isinstance(v, (int, float)) else (c, F.lit(v))
    return c, _value(kind, v)


def condition(df: DataFrame, f: Filter) -> Column:
    kind, c = _type_of(df, f.field), F.col(f.field)
    if f.op in ("eq", "neq"):
        if isinstance(kind, T.ArrayType):
            wanted = F.array(*[F.lit(str(v)) for v in f.value])
            held = F.transform(c, lambda x: F.trim(x.cast("string")))
            hit = F.size(F.array_except(wanted, held)) == 0 if f.match == "all" else F.arrays_overlap(held, wanted)
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            hit = reduce(Column.__or__, [c == _value(kind, v) for v in f.value])
        elif isinstance(kind, T.NumericType) and all(isinstance(v, (int, float)) for v in f.value):
            hit = c.isin(*f.value)
        else:
            hit = c.cast("string").isin(*[str(v) for v in f.value])
            if f.match == "all" and len({str(v) for v in f.value}) > 1:
                hit = F.lit(False)
        return hit if f.op == "eq" else F.coalesce(~hit, F.lit(True))
    if f.op == "range":
        low, high, closed = f.value
        a, low = _compare(c, kind, low)
        b, high = _compare(c, kind, high)
        return (a >= low) & ((b <= high) if closed else (b < high))
    a, v = _compare(c, kind, f.value)
    return {"gt": a > v, "gte": a >= v, "lt": a < v, "lte": a <= v}[f.op]


def _looked_up(df: DataFrame, lookup: Lookup, prefix: str) -> DataFrame:
    """Rows that match in the column of the highest priority that any row matches in."""
    held = [c for c in (*lookup.fields, *(prefix + k for k in lookup.fields)) if c in df.columns]
    if not held:
        raise QueryError("no key column")
    level = F.coalesce(*[F.when(F.col(c).cast("string") == str(lookup.value), F.lit(k)) for k, c in enumerate(held)])
    hits = df.withColumn("_level", level).where("_level IS NOT NULL")
    best = hits.agg(F.min("_level").alias("_best"))
    return hits.join(F.broadcast(best), F.col("_level") == F.col("_best")).drop("_level", "_best")  # one row


def bind(plan: Plan, df: DataFrame, order: str | None = None, prefix: str = "") -> DataFrame:
    """The rows of the plan. order: the column of the original order, which breaks ties (and reverses with desc)."""
    for f in plan.filters:
        df = df.where(condition(df, f))
    if plan.lookup:
        df = _looked_up(df, plan.lookup, prefix)
    if plan.sort:
        name, way = plan.sort
        _type_of(df, name)
        last = [] if order is None else [F.col(order).desc() if way == "desc" else F.col(order).asc()]
        df = df.orderBy(F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_first(), *last)
    elif order is not None:
        df = df.orderBy(order)
    return df if plan.limit is None else df.limit(plan.limit)


@dataclass
class Issue:
    severity: str
    category: str
    message: str


class Engine:
    """Runs lines over named tables; problems become issues, not exceptions, where asked for."""

    def __init__(self, tables: Callable[[str], DataFrame | None] | dict[str, DataFrame], order: dict[str, str] | None = None, prefixes: dict[str, str] | None = None):
        self.tables = tables.get if isinstance(tables, dict) else tables
        self.order, self.prefixes, self.issues = order or {}, prefixes or {}, []

    def resolve(self, source: str) -> tuple[str, DataFrame]:
        for name in (source, singular(source), source + "s", source + "es", re.sub(r"y$", "ies", source)):
            if (df := self.tables(name)) is not None:
                return name, df
        raise QueryError(f"no table {source}")

    def query(self, line: str) -> DataFrame:
        plan = parse(line)
        name, df = self.resolve(plan.source)
        return bind(plan, df, self.order.get(name), self.prefixes.get(name, ""))

    def one(self, line: str) -> DataFrame | None:
        """A key lookup whose number of rows is checked: none gives None, several give all and an issue."""
        df = self.query(line)
        n = df.limit(2).count()
        if n == 0:
            self.issues.append(Issue("warning", "lookup", f"nothing found: {line}"))
            return None
        if n > 1:
            self.issues.append(Issue("warning", "lookup", f"ambiguous, {df.count()} rows: {line}"))
        return df

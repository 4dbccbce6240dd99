"""Sources: record sets, Markdown and plain lines, word lists, lookup tables, catalogs."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.plans.querystream import singular

# Sections of a catalog and what number ranges mean.
SECTIONS = ("preface", "chapters", "appendices", "postface")


def _yaml(text: str):
    try:
        import yaml
    except ImportError as e:  # an optional package
        raise RuntimeError("YAML sources need the yaml package; JSON needs none") from e
    return yaml.safe_load(text)


def _text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    return rows[0]["value"] if rows else ""


def records(spark: SparkSession, rows: list[dict], schema: T.StructType | str | None = None, multi: tuple[str, ...] = ()) -> DataFrame:
    """A record set with its order in _ord. multi: fields that hold a list or a string with commas, made arrays."""
    rows = [dict(r) for r in rows]
    names = list(dict.fromkeys(k for r in rows for k in r))
    for r in rows:
        for k in multi:
            v = r.get(k)
            r[k] = None if v is None else [str(x).strip() for x in (v if isinstance(v, list) else str(v).split(","))]
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or T.StructType([T.StructField(k, _kind([r.get(k) for r in rows])) for k in names])
    fields = [*schema.fields, T.StructField("_ord", T.LongType())]
    return spark.createDataFrame([tuple(_cast(r.get(f.name), f.dataType) for f in schema.fields) + (n,) for n, r in enumerate(rows)], T.StructType(fields))


def _kind(values: list) -> T.DataType:
    held = [v for v in values if v is not None]
    if held and all(isinstance(v, dict) for v in held):
        return T.StructType([T.StructField(k, _kind([v.get(k) for v in held])) for k in dict.fromkeys(k for v in held for k in v)])
    if held and all(isinstance(v, list) for v in held):
        return T.ArrayType(_kind([x for v in held for x in v]))
    for kinds, out in (((bool,), T.BooleanType()), ((int,), T.LongType()), ((int, float), T.DoubleType())):
        if held and all(isinstance(v, kinds) and (bool in kinds or not isinstance(v, bool)) for v in held):
            return out
    import datetime as dt

    return T.DateType() if held and all(isinstance(v, dt.date) for v in held) else T.StringType()


def _cast(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_cast(v.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return [_cast(x, kind.elementType) for x in (v if isinstance(v, list) else [v])]
    return float(v) if isinstance(kind, T.DoubleType) else str(v) if isinstance(kind, T.StringType) else v


def read_yaml(spark: SparkSession, path: str, schema=None, multi: tuple[str, ...] = ()) -> DataFrame:
    return records(spark, _yaml(_text(spark, path)) or [], schema, multi)


def read_json(spark: SparkSession, path: str, schema=None, multi: tuple[str, ...] = ()) -> DataFrame:
    """A JSON array of records; large files of one record a line are Spark's own json source."""
    return records(spark, json.loads(_text(spark, path)), schema, multi)


def table_path(folder: str, source: str, listing: list[str]) -> str | None:
    """The file of a source: the name as written, then its plural and singular forms, YAML before JSON."""
    for name in dict.fromkeys((source, source + "s", source + "es", re.sub(r"y$", "ies", source), re.sub(r"fe?$", "ves", source), singular(source))):
        for ext in (".yml", ".yaml", ".json"):
            if name + ext in listing:
                return f"{folder}/{name}{ext}"
    return None


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, basename, chapter_num, content) of each file; files with an underscore in their name are not chapters."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    base = F.regexp_extract("path", r"([^/]+?)(?:\.md)?$", 1)
    df = df.withColumn("basename", base).where(~F.col("basename").contains("_"))
    return df.select("path", "basename", F.regexp_extract("basename", r"^(\d+)", 1).try_cast("int").alias("chapter_num"), "content")


def lines(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(keep..., line (1-based), content); a trailing line feed ends the last line and begins none."""
    cut = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    each = docs.select(*keep, F.posexplode(F.split(cut, "\n", -1)).alias("pos", "content"))
    return each.select(*keep, (F.col("pos") + 1).alias("line"), "content")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(key, word) of a spelling list: comments and affix flags off; compound words count without their hyphens too."""
    w = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"#.*$|/.*$", "")).alias("word"))
    w = w.select(F.regexp_replace("word", "[^a-zA-Z0-9-]", "").alias("word")).where("word <> ''")
    plain = w.select(F.lower("word").alias("key"), "word")
    return plain.union(w.where(F.col("word").contains("-")).select(F.lower(F.regexp_replace("word", "-", "")).alias("key"), "word")).dropDuplicates(["key"])


def read_lookup(spark: SparkSession, path: str, names: str) -> DataFrame:
    """A table of tab-separated values with # comments."""
    return spark.read.csv(path, sep="\t", comment="#", schema=names)


def expand_numbers(spec, swapped: bool = True) -> list[int]:
    """[1, "3-5"] -> numbers; ranges written backwards are turned round, or dropped."""
    out: list[int] = []
    for part in spec if isinstance(spec, list) else str(spec).split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", str(part))
        if m:
            a, b = int(m[1]), int(m[2] or m[1])
            out += range(a, b + 1) if a <= b else range(b, a + 1) if swapped else ()
    return out


def read_catalog(spark: SparkSession, tree) -> DataFrame:
    """(ord, section, part, basename) of a catalog: a tree of sections, parts and chapter names (or YAML text of one)."""
    tree = _yaml(tree) if isinstance(tree, str) else tree
    rows: list[tuple] = []

    def walk(node, section: str, part: str | None) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(v, section, str(k))
        elif isinstance(node, list):
            for v in node:
                walk(v, section, part)
        elif node is not None:
            for name in (str(n) for n in str(node).split(",")):
                m = re.fullmatch(r"\s*(\d+)-(\d+)\s*", name)
                for one in [f"{n:02d}" for n in range(int(m[1]), int(m[2]) + 1)] if m else [name.strip()]:
                    rows.append((len(rows), section, part, os.path.splitext(one)[0]))

    for section in SECTIONS:
        walk((tree or {}).get(section), section, None)
    return spark.createDataFrame(rows, "ord int, section string, part string, basename string")


def html_titles(pages: DataFrame, html: str = "html", name: str = "url") -> DataFrame:
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.withColumn("title", F.coalesce(F.when(F.trim(title) != "", F.trim(title)), F.col(name)))

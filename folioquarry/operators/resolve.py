"""Chapter names typed by hand, resolved against a catalog and a file listing by ordered joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.functions.text import ascii_slug, chapter_kind
from folioquarry.sources.records import expand_numbers


def normalise(tokens: list[str]) -> list[str]:
    """Tokens without folders and file endings; number ranges expanded, in either direction."""
    out: list[str] = []
    for t in tokens:
        name = t.strip().rsplit("/", 1)[-1].removesuffix(".md")
        if name:
            out += [str(n) for n in expand_numbers([name])] if name.replace("-", "").isdigit() and "-" in name else [name]
    return list(dict.fromkeys(out))


def resolve_tokens(tokens: DataFrame, catalog: DataFrame, files: DataFrame) -> DataFrame:
    """(token, basename, label): label is CATALOG, UNCATALOGED (a file only), NEW or INVALID.

    tokens: (token); catalog and files: (basename) such as 02-history or 02. A number with a name must be in the catalog as it
    is; a number alone takes the catalog's entry, then a file with a name, then a bare file; a name alone must be the name of
    one entry, or of one file.
    """
    parts = lambda df, label: df.select("basename", F.lpad(F.regexp_extract("basename", r"^(\d+)", 1), 2, "0").alias("number"), F.lower(F.regexp_extract("basename", r"^\d+[-_](.+)$", 1)).alias("slug"), F.lit(label).alias("label"))
    every = parts(catalog, "CATALOG").unionByName(parts(files.join(catalog, "basename", "left_anti"), "UNCATALOGED")).dropDuplicates(["basename"])
    t = tokens.select("token").distinct().withColumns({"number": F.regexp_extract("token", r"^(\d+)", 1), "slug": F.lower(F.regexp_extract("token", r"^\d+[-_](.+)$", 1))})
    t = t.withColumn("number", F.when(F.col("number") != "", F.lpad("number", 2, "0")).otherwise("")).withColumn("slug", F.when(F.col("number") == "", ascii_slug("token")).otherwise(F.col("slug")))
    e = every.select("basename", F.col("number").alias("n"), F.col("slug").alias("s"), "label")
    both = t.where("number <> '' AND slug <> ''").join(e.where("label = 'CATALOG'"), (F.col("number") == F.col("n")) & (F.col("slug") == F.col("s")))
    number = t.where("number <> '' AND slug = ''").join(e, F.col("number") == F.col("n"))
    named = t.where("number = '' AND slug <> ''").join(e, F.col("slug") == F.col("s"))
    several = F.count_if(F.col("label") == "UNCATALOGED").over(W.partitionBy("token"))
    first = F.min("label").over(W.partitionBy("token"))
    named = named.withColumn("label", F.when((first != "CATALOG") & (several > 1), "INVALID").otherwise(F.col("label")))
    hits = both.unionByName(number).unionByName(named)
    rank = F.row_number().over(W.partitionBy("token").orderBy(F.when(F.col("label") == "CATALOG", 0).otherwise(1), F.when(F.col("s") != "", 0).otherwise(1), "basename"))
    best = hits.withColumn("_k", rank).where("_k = 1").select("token", "basename", "label")
    out = t.join(best, "token", "left")
    label = F.coalesce("label", F.when((F.col("number") == "") & (F.col("slug") == ""), "INVALID").otherwise("NEW"))
    return out.select("token", F.when(label != "INVALID", F.coalesce("basename", "token")).alias("basename"), label.alias("label"))


def with_kind(entries: DataFrame) -> DataFrame:
    return entries.withColumn("kind", chapter_kind(F.regexp_extract("basename", r"^(\d+)", 1).try_cast("int")))


def display_numbers(catalog: DataFrame) -> DataFrame:
    """Catalog entries with display: chapters count from 1, appendices from A, in the order of their numbers."""
    c = with_kind(catalog)
    n = F.row_number().over(W.partitionBy("kind").orderBy(F.regexp_extract("basename", r"^(\d+)", 1).try_cast("int"), "basename"))
    return c.withColumn("display", F.when(F.col("kind") == "chapter", n.cast("string")).when(F.col("kind") == "appendix", F.char(F.lit(64) + n)))

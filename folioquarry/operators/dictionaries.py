"""Set operations on term dictionaries and catalogs; each returns a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_terms(old: DataFrame, new: DataFrame, prefer_new: bool = True) -> DataFrame:
    """(term, reading, flags, definition): flags are united (in their order), other values of the preferred side win if present."""
    a, b = old.alias("a"), new.alias("b")
    j = a.join(b, F.col("a.term") == F.col("b.term"), "full_outer")
    first, second = ("b", "a") if prefer_new else ("a", "b")
    pick = lambda c: F.coalesce(F.when(F.trim(F.col(f"{first}.{c}")) != "", F.col(f"{first}.{c}")), F.col(f"{second}.{c}")).alias(c)
    flags = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.concat(F.coalesce("a.flags", F.lit("")), F.coalesce("b.flags", F.lit(""))), ""), lambda x: x != ""))), "")
    order = F.concat(F.when(flags.contains("i"), "i").otherwise(""), F.when(flags.contains("g"), "g").otherwise(""), F.translate(flags, "ig", ""))
    return j.select(F.coalesce("a.term", "b.term").alias("term"), pick("reading"), order.alias("flags"), pick("definition"))


def remove_flag(terms: DataFrame, term: str, flag: str) -> DataFrame:
    left = F.when(F.col("term") == term, F.translate("flags", flag, "")).otherwise(F.col("flags"))
    return terms.withColumn("flags", left).where("flags <> ''")


def insert_absent(old: DataFrame, new: DataFrame, key: str = "term") -> DataFrame:
    return old.unionByName(first_by(new, [key], new.columns).join(old.select(key), key, "left_anti").select(*old.columns), allowMissingColumns=True)


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_k = 1").drop("_k")


def functional(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n) of keys that map to one value only, most frequent first."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_x"), F.count("*").alias("n")).where(F.col(value) == F.col("_x")).drop("_x").orderBy(F.desc("n"), key)


def selectable(candidates: DataFrame, registered: DataFrame, rejected: DataFrame, key: str = "term") -> DataFrame:
    return candidates.join(registered.select(key), key, "left_anti").join(rejected.select(key), key, "left_anti")


def upsert_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """(word): unique without regard to case, the old spelling first, sorted."""
    both = old.select("word", F.lit(0).alias("o")).union(new.select("word", F.lit(1).alias("o")))
    return first_by(both.withColumn("_l", F.lower("word")), ["_l"], ["o", "word"]).select("word").orderBy(F.lower("word"))


def free_number(used: DataFrame, column: str, low: int = 1, high: int = 98) -> int | None:
    """The smallest number of a short range that is not used."""
    every = used.sparkSession.range(low, high + 1).withColumnRenamed("id", "_n")
    return every.join(used.select(F.col(column).alias("_n")), "_n", "left_anti").agg(F.min("_n")).first()[0]


def renumber(chapters: DataFrame, order: str, start: int = 1, step: int = 1, last: int = 89) -> DataFrame:
    """A chapter list with number = start + i * step; the step shrinks until the last number fits."""
    n = chapters.count()
    step = step if n < 2 else max(1, min(step, (last - start) // (n - 1)))
    return chapters.withColumn("number", F.lit(start) + (F.row_number().over(W.orderBy(order)) - 1) * step)  # one book's chapters


def catalog_insert(catalog: DataFrame, section: str, basename: str) -> DataFrame:
    spark = catalog.sparkSession
    new = spark.createDataFrame([(section, None, basename)], "section string, part string, basename string")
    every = catalog.select("section", "part", "basename").union(new).dropDuplicates(["section", "basename"])
    return every.withColumn("ord", F.row_number().over(W.orderBy("section", F.regexp_extract("basename", r"^(\d+)", 1).try_cast("int"), "basename")) - 1)

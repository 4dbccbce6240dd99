"""Running numbers over all rows in an order, by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

MOST_RANGES = 256


def numbered(df: DataFrame, *order: str, weight: str | None = None, name: str = "_hi") -> DataFrame:
    """df with a running count (or sum of a weight) in an order of all rows, in two passes without gathering them in one task.

    Bounds from a bounded sample cut the rows into ranges; sums per range give each range its start; within a range a window
    goes on from there. Any bounds give the same numbers. Nulls sort first; equal rows are numbered in any order.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    parts = min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = F.struct(*order)
    cuts = _cuts(df, order, parts)
    kind = df.select(keys.alias("k")).schema["k"].dataType
    d = df.withColumn("_p", _range_of(keys, cuts, kind))
    sums = d.groupBy("_p").agg(F.sum(w).alias("_s"))
    start = sums.withColumn("_b", F.sum("_s").over(W.orderBy("_p")) - F.col("_s")).drop("_s")  # a row a range
    inside = F.sum(w).over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("_in", inside).join(F.broadcast(start), "_p").withColumn(name, (F.col("_b") + F.col("_in")).cast("long")).drop("_p", "_in", "_b")


def _cuts(df: DataFrame, order: tuple[str, ...], parts: int) -> list:
    """Bounds of about equal ranges, from the rows with the smallest hashes (64 a range at most)."""
    key = [F.col(c) for c in order]
    some = df.select(*key).orderBy(F.xxhash64(*key)).limit(64 * parts).orderBy(*order).collect()
    step = max(1, len(some) // parts)
    return [tuple(r) for r in some[step::step]]


def _range_of(keys: Column, cuts: list, kind: DataType) -> Column:
    """How many of the bounds lie below a row."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[F.lit(v) for v in c]) for c in cuts]).cast(ArrayType(kind))
    return F.size(F.filter(bounds, lambda b: b < keys))

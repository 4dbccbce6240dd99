"""Sharding by sampled splitters: DataFrame functions only.

Records are ordered by (hash of the text, id), so equal texts lie side by side. A sample drawn with a chance in
proportion to the size of a record gives quantile boundaries; records are dealt to the ranges between them; ranges that
come out overfull are sampled again and subdivided. Running sums within a range plus the totals of the ranges before it
place each record exactly, so shards differ by about one record, or one small group of equal texts.

Only (id, size, checksum, hash) of a record is shuffled. What reaches the driver is the sample (``SAMPLE_PER_RANGE`` rows
a range) and one row a range, for ``MAX_RANGES`` ranges at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.llm.common import id_back, id_key, written

ROWS_PER_RANGE = 1_000_000
MIN_RANGES, MAX_RANGES = 64, 4096
SAMPLE_PER_RANGE = 64
OVERFULL = 1.5
SUBDIVISIONS = 3
#: A group of equal texts below this part of a shard is not split between shards.
WHOLE_GROUP = 0.01
_U = float(2**53)


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are not above (h, id), by binary search."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    hs, ids = _longs([s[0] for s in splitters]), _longs([s[1] for s in splitters])

    def step(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        a, b = F.get(hs, mid), F.get(ids, mid)
        below = (F.col("h") < a) | ((F.col("h") == a) & (F.col("id") < b))
        done = acc["lo"] >= acc["hi"]
        return F.struct(
            F.when(done | below, acc["lo"]).otherwise(mid + 1).cast("int").alias("lo"),
            F.when(done | ~below, acc["hi"]).otherwise(mid).cast("int").alias("hi"),
        )

    rounds = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda a: a["lo"])


def _draw(rows: DataFrame, per_byte: float, seed: int) -> list[tuple[int, int, float]]:
    """A sample in which a record's chance is its size times per_byte; records beyond a chance of 1 weigh more."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("id"), F.col("h")), 11) / F.lit(_U)
    chance = F.col("size") * F.lit(per_byte)
    drawn = rows.where(u < chance).select("h", "id", F.greatest(F.lit(1.0), chance).alias("w"))
    return sorted((r["h"], r["id"], r["w"]) for r in drawn.collect())


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    total, seen, out = sum(w for _, _, w in sample), 0.0, []
    for h, i, w in sample:
        if len(out) + 1 < parts and seen >= total * (len(out) + 1) / parts:
            out.append((h, i))
        seen += w
    return out


def _tidy(splitters: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The first splitter inside a group of equal texts moves to its start, so that only large groups are cut."""
    out: list[tuple[int, int]] = []
    for h, i in sorted(set(splitters)):
        out.append((h, i) if out and out[-1][0] == h else (h, -(2**63)))
    return out


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law).

    size is the UTF-8 length plus 1; null and empty texts have size 1 and checksum 0. Null ids are kept and sort before
    all others. Repeated rows are placed one by one. An empty table gives an empty result. Other columns are not read,
    so clashing names do no harm.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            id_key(id_col).alias("id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("crc"),
            F.xxhash64(text).alias("h"),
        ),
        "shard-keys",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    wanted = min(MAX_RANGES, max(MIN_RANGES, math.ceil(n / ROWS_PER_RANGE)))
    share = max(1.0, total / wanted)
    splitters = _tidy(_quantiles(_draw(rows, SAMPLE_PER_RANGE / share, 0), wanted))
    for again in range(1, SUBDIVISIONS + 1):
        ranged = rows.withColumn("r", _range_of(splitters))
        sizes = {x["r"]: (x["b"], x["n"]) for x in ranged.groupBy("r").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        over = [r for r, (b, k) in sizes.items() if b > OVERFULL * share and k > 1]
        if not over or again == SUBDIVISIONS or len(splitters) + 1 >= 2 * MAX_RANGES:
            break
        by_range: dict[int, list] = {r: [] for r in over}
        bounds = splitters
        for x in _draw(ranged.where(F.col("r").isin(over)), SAMPLE_PER_RANGE * 2 / share, again):
            lo, hi = 0, len(bounds)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if x[:2] < bounds[mid] else (mid + 1, hi)
            by_range.setdefault(lo, []).append(x)
        more = [s for r, xs in by_range.items() for s in _quantiles(xs, math.ceil(sizes[r][0] / share) if r in sizes else 1)]
        if not set(more) - set(splitters):
            break
        splitters = _tidy(splitters + more)

    before_b, before_n, at_b, at_n = [], [], 0, 0
    for r in range(len(splitters) + 1):
        before_b.append(at_b)
        before_n.append(at_n)
        at_b, at_n = at_b + sizes.get(r, (0, 0))[0], at_n + sizes.get(r, (0, 0))[1]
    in_range = W.partitionBy("r").orderBy("h", "id")
    group = W.partitionBy("r", "h")
    size, so_far = F.col("size"), F.sum("size").over(in_range.rowsBetween(W.unboundedPreceding, 0))
    placed = (
        ranged.withColumn("at", F.get(_longs(before_b), F.col("r")) + so_far - size)
        .withColumn("row", F.get(_longs(before_n), F.col("r")) + F.row_number().over(in_range) - 1)
        .withColumn("g_size", F.sum("size").over(group))
        .withColumn("g_at", F.min("at").over(group))
    )
    whole = F.col("g_size") <= F.lit(WHOLE_GROUP * total / shards)
    middle = F.when(whole, F.col("g_at") + F.col("g_size") / 2).otherwise(F.col("at") + size / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int")
    placed = written(placed.select("id", "size", "crc", "row", shard.alias("shard")), "shard-rows")
    first = {x["shard"]: x["row"] for x in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    return placed.select(
        id_back(F.col("id")).alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.get(_longs([first.get(s, 0) for s in range(shards)]), F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes docs, all columns, under path/shard=k/ with slot, in slot order within each file.

    Each row has a slot of its own, repeated rows too: the n-th row of an id and text takes the n-th slot that they have.
    Null ids and texts are kept; columns named shard or slot are replaced; an empty table writes no rows.
    """
    where = assign_shards(docs, shards).select(id_key().alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    where = where.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_crc").orderBy("shard", "slot")))
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.drop("shard", "slot").select(F.struct("*").alias("row"))
    rows = rows.select("row", id_key("row.doc_id").alias("_id"), F.crc32(F.encode(text, "UTF-8")).alias("_crc"))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_id", "_crc").orderBy(F.xxhash64("row"))))
    out = rows.join(where, ["_id", "_crc", "_nth"]).select("row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

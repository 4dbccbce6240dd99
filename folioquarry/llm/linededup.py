"""Line dedup: hashes dealt by range, sorted by (hash, document, position), first occurrences streamed.

Each task reads its sorted run once with a few scalars of state. A run of one hash that crosses a task boundary is
settled afterwards from one row per task (its last hash and that hash's first document), so a line that a third of all
rows share is spread over many tasks. The answer is a compressed bitmap of lines to keep per document, not text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquarry.llm.common import id_key, written

MIN_CHARS = 10
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DROP, _OPEN, _EDGE = 0, 1, 2
_STREAM = "kind int, part int, h1 long, h2 long, id long, th long, pos int, first long"


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(id_key().alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    each = each.withColumn("line", F.translate(F.btrim("line", F.lit(SPACE)), _UPPER, _LOWER)).where(F.length("line") >= MIN_CHARS)
    return each.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "id", "th", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dropped lines; lines of the task's first hash, still open; and the edge: the task's last hash."""
    part = TaskContext.get().partitionId()
    last: tuple[int, int] | None = None
    first_key: tuple[int, int] | None = None
    keeper = 0

    def rows(kind: int, h1, h2, ids, th, pos, first) -> pa.RecordBatch:
        n = len(ids)
        cols = [np.full(n, kind, np.int32), np.full(n, part, np.int32), h1, h2, ids, th, pos, first]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "part", "h1", "h2", "id", "th", "pos", "first"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, ids, th, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        new = np.empty(len(h1), bool)
        new[0] = last != (h1[0], h2[0])
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        # run -1 goes on from the batch before
        firsts = np.append(ids[starts], keeper)[run]
        if first_key is None:
            first_key = (int(h1[0]), int(h2[0]))
        is_open = (h1 == first_key[0]) & (h2 == first_key[1])
        drop = ~is_open & (ids != firsts)
        for kind, mask in ((_DROP, drop), (_OPEN, is_open)):
            if mask.any():
                yield rows(kind, h1[mask], h2[mask], ids[mask], th[mask], pos[mask], firsts[mask])
        last, keeper = (int(h1[-1]), int(h2[-1])), int(firsts[-1])
    if last is not None:
        one = lambda v, t=np.int64: np.array([v], t)
        yield rows(_EDGE, one(last[0]), one(last[1]), one(0), one(0), one(0, np.int32), one(keeper))


@F.pandas_udf(T.BinaryType())
def _bitmap(drops: pd.Series) -> pd.Series:
    return drops.map(lambda p: pack(p))


def pack(dropped) -> bytes:
    """Positions to drop as a compressed bitmap of lines to keep; lines past its end are kept."""
    bits = np.ones(int(max(dropped)) + 1, np.uint8)
    bits[np.asarray(dropped)] = 0
    return zlib.compress(len(bits).to_bytes(4, "little") + np.packbits(bits).tobytes(), 6)


def unpack(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=4), count=int.from_bytes(raw[:4], "little")).astype(bool)


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(id, th, bitmap) for every document that loses lines; th is the hash of its text, id is never null.

    Keys of MIN_CHARS code points or more that at least two documents hold stay only in the smallest id; a null id is the
    smallest. Rows with one id are one document here; equal rows lose the same lines.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "id", "th", "pos"]
    runs = _lines(docs).repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = written(runs.mapInArrow(_stream, _STREAM), "line-runs")
    edges = sorted(tuple(r) for r in runs.where(F.col("kind") == _EDGE).select("part", "h1", "h2", "first").collect())
    begun: dict[tuple[int, int], int] = {}
    carried = []
    for part, h1, h2, first in edges:  # one row a task
        carried += [(part, *key, keeper) for key, keeper in begun.items()]
        begun = {(h1, h2): begun.get((h1, h2), first)}
    carried = spark.createDataFrame(carried, "part int, h1 long, h2 long, keeper long")
    opened = runs.where(F.col("kind") == _OPEN).join(F.broadcast(carried), ["part", "h1", "h2"], "left")
    opened = opened.where(F.col("id") != F.coalesce("keeper", "first"))
    dropped = runs.where(F.col("kind") == _DROP).select("id", "th", "pos").unionByName(opened.select("id", "th", "pos"))
    return dropped.groupBy("id", "th").agg(F.collect_set("pos").alias("drops")).select("id", "th", _bitmap("drops").alias("bitmap"))


def with_bitmaps(docs: DataFrame) -> DataFrame:
    """(row, keep): each row of docs as a struct, and its bitmap, or null where nothing is dropped."""
    rows = docs.select(F.struct("*").alias("row"), id_key().alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"))
    return rows.join(keep_bitmaps(docs), ["id", "th"], "left").select("row", F.col("bitmap").alias("keep"))


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[list[str], int]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines, len(lines)
    keep = unpack(bitmap)
    return [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]], len(lines)


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256. Null and empty texts are one empty line."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, dropped, sha = b.column(0), [], [], []
            for text, bitmap in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, lines = kept_lines(text, bitmap)
                n.append(lines)
                dropped.append(lines - len(kept))
                sha.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    with_maps = with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return with_maps.select("row.doc_id", "row.text", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with their text cut down to the kept lines; n_chars, where there is one, follows. No row is dropped."""

    @F.pandas_udf(T.StringType())
    def cut(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(kept_lines(t, m)[0]) for t, m in zip(text, bitmap, strict=True)], dtype=object)

    new = F.when(F.col("keep").isNotNull(), cut("row.text", "keep")).otherwise(F.col("row.text"))
    out = with_bitmaps(docs).select(F.col("row").withField("text", new).alias("row")).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone
  FROM keyed LEFT JOIN held USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

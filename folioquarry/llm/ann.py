"""Approximate nearest neighbours: inverted lists scanned dimension by dimension, with early abandoning.

Vectors are rotated by one random orthogonal matrix, so that a few leading coordinates estimate the whole distance. Every
row goes to the list of its nearest centre (centres come from a bounded sample); large lists are split into blocks of
about BLOCK rows by a hash of the id. A query visits as many of its nearest lists as the sample shows to be needed.
Within a block the rows lie in column
blocks: after each, a hypothesis test on the partial distance (Gao and Long, 2023) drops the rows that almost surely
cannot be among the k nearest. Survivors are ranked by the exact distance of the original vectors in double precision.

Memory of a task is bounded by a block and the queries that visit it, which are worked off in runs. What is broadcast is
the rotation and at most MAX_LISTS centres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE, ROUNDS, MAX_LISTS = 20_000, 8, 4096
#: Probed lists: at least so many, and as many as hold this part of the true neighbours of TRIALS rows within the sample.
PROBES, COVER, TRIALS = 8, 0.97, 256
BLOCK = 4096
STEP = 16
#: Of the test: the larger, the surer and the slower.
EPSILON = 2.1
_OUT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: of the commonest length, all components finite, not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("embedding") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centres of each row, nearest first."""
    out = np.empty((len(x), m), np.int32)
    half = (c * c).sum(1) / 2
    for a in range(0, len(x), 2048):
        d = half - x[a : a + 2048] @ c.T
        out[a : a + 2048] = np.argsort(d, 1, kind="stable")[:, :m] if m > 1 else d.argmin(1)[:, None]
    return out


def _probes(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """How many lists to visit: enough for COVER of the k nearest of TRIALS sample rows (in a sparser set, so on the safe side)."""
    own = _nearest(x, c, 1)[:, 0]
    q = np.random.default_rng(5).choice(len(x), min(TRIALS, len(x)), replace=False)
    place = np.argsort(_nearest(x[q], c, len(c)), 1, kind="stable")
    far = (x * x).sum(1) - 2 * x[q] @ x.T
    far[np.arange(len(q)), q] = np.inf
    near = np.argpartition(far, min(k, len(x) - 1), 1)[:, :k]
    needed = np.take_along_axis(place, own[near], 1) + 1
    return int(min(len(c), max(PROBES, np.ceil(np.quantile(needed, COVER)))))


def scan_block(base: np.ndarray, rotated: list[np.ndarray], ids: np.ndarray, query: np.ndarray, turned: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest rows of a block; rotated: column blocks of its rotated rows."""
    d_all = base.shape[1]
    first = np.arange(min(len(ids), max(64, 4 * k)))
    rows = np.arange(len(first), len(ids))
    own = ids[first] != query_id
    exact = lambda r: np.sqrt(((base[r] - query) ** 2).sum(1))
    head = first[own]
    found = exact(head)
    limit = np.partition(found, k - 1)[k - 1] ** 2 if len(found) >= k else np.inf
    part, done = np.zeros(len(rows)), 0
    rounding = 1e-9 * float(query @ query)  # of the rotations; copies of the query must not fall to it
    for cols in rotated:
        diff = cols[rows] - turned[done : done + cols.shape[1]]
        part += np.einsum("ij,ij->i", diff, diff)
        done += cols.shape[1]
        slack = (1 + EPSILON / np.sqrt(done)) ** 2 if done < d_all else 1 + 1e-9
        stay = part * (d_all / done) <= limit * slack + rounding
        rows, part = rows[stay], part[stay]
        if not len(rows):
            break
    rows = rows[ids[rows] != query_id]
    both = np.concatenate([head, rows])
    dist = np.concatenate([found, exact(rows)])
    best = np.lexsort((ids[both], dist))[:k]
    return ids[both[best]], dist[best]


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows whose vec_id is divisible by `every`, against all others.

    score is the Euclidean distance of the original vectors; ties go to the smaller vec_id. Vectors that are null or zero,
    hold null or non-finite components, have another length than the commonest or no id take no part. Rows that share the
    query's id are not its neighbours; of repeated query rows the smallest vector asks (component by component). Lists are
    visited until they hold k rows besides the query's own, so fewer than k come back only where there are no more. An empty table gives an empty result; other columns
    are not read.
    """
    spark = vectors.sparkSession
    v = usable(vectors)
    n = v.count()
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    x = _matrix(sample["embedding"])
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dims, dims)))[0]
    lists = int(min(MAX_LISTS, len(x), max(1, round(n**0.5))))
    centres = _centres(x @ rotation, lists)
    probes = _probes(x @ rotation, centres, k)
    held = spark.sparkContext.broadcast((rotation, centres))

    def route(probes: int, rows: np.ndarray | None = None, least: int = 0):
        """The nearest lists of each row: `probes`, and as many more as it takes to hold `least` rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turn, centres = held.value
            for b in batches:
                if b.num_rows:
                    near = _nearest(_matrix(b.column(1)) @ turn, centres, probes if rows is None else len(centres))
                    many = np.full(len(near), probes)
                    if rows is not None:
                        many = np.clip((np.cumsum(rows[near], 1) < least).sum(1) + 1, probes, len(centres))
                    flat = near[np.arange(near.shape[1]) < many[:, None]]
                    ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vec_id", "embedding", "lists"])

        return run

    shape = "vec_id long, embedding array<double>, lists array<int>"
    base = v.mapInArrow(route(1), shape).select("vec_id", "embedding", F.col("lists")[0].alias("list"))
    sizes = {r["list"]: r["count"] for r in base.groupBy("list").count().collect()}
    blocks = F.array(*[F.lit(max(1, -(-sizes.get(i, 0) // BLOCK))) for i in range(lists)])
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(blocks, F.col("list"))).cast("int"))
    asked = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count("*").alias("copies"))
    copies = asked.agg(F.max("copies")).first()[0] or 0
    rows = np.array([sizes.get(i, 0) for i in range(lists)])
    asked = asked.drop("copies").mapInArrow(route(probes, rows, k + copies), shape)
    asked = asked.select("vec_id", "embedding", F.explode("lists").alias("list"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)))

    def visit(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            turn = held.value[0]
            ids, mat = rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
            turned = mat @ turn
            cols = [np.ascontiguousarray(turned[:, a : a + STEP]) for a in range(0, dims, STEP)]
            q_ids, q = queries["vec_id"].to_numpy(), _matrix(queries["embedding"])
            for a in range(0, len(q), 1024):
                q_turned = q[a : a + 1024] @ turn
                for i, vec, t in zip(q_ids[a : a + 1024], q[a : a + 1024], q_turned, strict=True):
                    near, dist = scan_block(mat, cols, ids, vec, t, i, k)
                    out[0].append(np.full(len(near), i))
                    out[1].append(near)
                    out[2].append(dist)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    key = ["list", "block"]
    found = base.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(visit, _OUT)
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

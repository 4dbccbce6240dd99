"""Toxicity by non-negative positive-unlabelled learning, with classifiers trained in numpy.

Positives are confirmed toxic documents; everything else is unlabelled text of the corpus, toxic or not. The risk of a
classifier g with class prior p is  p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]);  where the bracket turns
negative, the step goes back along its gradient, which keeps a flexible model from overfitting (Kiryo et al., 2017).

A text is folded to words in lower case with single blanks between, and seen as its set of byte n-grams, blanks
included, so marked words are found by stem as well as whole. N-grams that are far more common in positives than in
unlabelled text are the features; three classifiers on resampled documents are averaged. A set of n-grams cannot drown in
a long text: scoring reads every byte and adds a weight once per n-gram and document.

Training reads a bounded sample (POSITIVES and UNLABELLED documents, SAMPLE_BYTES of text at most, picked by hash); the
class prior is counted over all labels of the training fold. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.fold import folded, slices

POSITIVES, UNLABELLED, SAMPLE_BYTES = 2_500, 8_000, 64 << 20
LENGTHS = (6, 8)
FEATURES, MIN_POSITIVES, MIN_Z = 600, 5, 7.0
MODELS, EPOCHS, BATCH, RATE, DECAY = 3, 30, 512, 0.05, 1e-5
#: So many unlabelled texts rule out common n-grams before all of them are counted.
FIRST_LOOK = 1_000
_FILTER_BITS = 20


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, text number) of all n-grams of the texts, for each length."""
    buf, ends = folded(texts, 9)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends))
    buf = buf.astype(np.uint32)
    h = {1: buf}
    for n in (2, 4):
        half = h[n // 2]
        h[n] = half[: len(half) - n // 2] * np.uint32(0x01000193 + 2 * n) + half[n // 2 :]
        h[n] ^= h[n] >> np.uint32(15)
    for n in LENGTHS:
        a, b = h[4], h[n - 4]
        m = min(len(a), len(b) - 4)
        if m <= 0:
            continue
        x = (a[:m] * np.uint32(0x9E3779B1) + b[4 : 4 + m] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        x ^= x >> np.uint32(16)
        x *= np.uint32(2 * n + 0x27D4EB2F)
        inside = owner[:m] == owner[n - 1 : n - 1 + m]
        yield x[inside], owner[:m][inside]


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint32(32 - _FILTER_BITS)] = True

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature number) of the features of each text, each pair once."""
        pairs = [np.empty(0, np.int64)]
        k = len(self.hashes)
        for x, owner in _grams(texts):
            hit = np.flatnonzero(self.filter[x >> np.uint32(32 - _FILTER_BITS)])
            x, owner = x[hit], owner[hit]
            at = np.minimum(np.searchsorted(self.hashes, x), k - 1)
            same = self.hashes[at] == x
            pairs.append(owner[same].astype(np.int64) * k + at[same])
        both = np.unique(np.concatenate(pairs))
        return both // k, both % k

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.hashes):
            for first, part in slices(texts):
                doc, feature = self.present(part)
                out[first : first + len(part)] += np.bincount(doc, self.weights[feature], len(part))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _counts(texts: list[str | None], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """N-gram hashes and the number of texts that hold each; only those in the sorted array `among`."""
    if among is not None:
        model = Model(among, np.zeros(len(among)), 0.0)
        n = np.zeros(len(among), np.int64)
        for _, part in slices(texts):
            n += np.bincount(model.present(part)[1], minlength=len(among))
        return among, n
    out = [np.empty(0, np.uint32)]
    for _, part in slices(texts):
        pairs = [(owner.astype(np.uint64) << np.uint64(32)) | x for x, owner in _grams(part)]
        if pairs:
            out.append(np.unique(np.concatenate(pairs)).astype(np.uint32))
    return np.unique(np.concatenate(out), return_counts=True)


def _choose(pos: list, unl: list) -> np.ndarray:
    """Hashes of the n-grams that are most clearly over-represented in positives."""
    hashes, n1 = _counts(pos)
    often = n1 >= max(MIN_POSITIVES, len(pos) // 250)
    hashes, n1 = hashes[often], n1[often]
    for some in (unl[:FIRST_LOOK], unl):
        if not len(hashes) or not unl:
            return np.empty(0, np.uint32)
        _, n0 = _counts(some, hashes)
        rare = n1 / len(pos) > 2 * n0 / len(some)
        hashes, n1, n0 = hashes[rare], n1[rare], n0[rare]
    p = (n1 + n0) / (len(pos) + len(unl))
    z = (n1 / len(pos) - n0 / len(unl)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / len(pos) + 1 / len(unl)))
    best = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(hashes[best[z[best] >= MIN_Z]])


def _sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _fit(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Minimises the non-negative risk (logistic loss) by Adam over mini-batches of both samples."""
    rng = np.random.default_rng(seed)
    xp, xu = xp[rng.integers(0, len(xp), len(xp))], xu[rng.integers(0, len(xu), len(xu))]
    w = np.zeros(xp.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    decay = np.full(len(w), DECAY, np.float32)
    decay[-1] = 0
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    prior = np.float32(prior)
    for _ in range(EPOCHS):
        order = rng.permutation(len(xu))
        for a in range(0, len(xu), BATCH):
            bu, bp = xu[order[a : a + BATCH]], xp[rng.integers(0, len(xp), BATCH)]
            sp, su = bp @ w, bu @ w
            as_neg = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
            pp = _sigmoid(sp)
            neg = _sigmoid(su) @ bu / len(bu) - prior * (pp @ bp) / len(bp)
            g = prior * ((pp - 1) @ bp) / len(bp) + neg if as_neg >= 0 else -neg
            g = (g + decay * w).astype(np.float32)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = (w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
            np.maximum(w[:-1], 0, out=w[:-1])  # every feature is over-represented in positives
    return w[:-1].astype(np.float64), float(w[-1])


def _threshold(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """Of the cuts that have the least non-negative zero-one risk on the sample, the one in the widest gap."""
    values = np.unique(np.concatenate([gp, gu, gp[:1] - 1]))
    cuts, gaps = (values[1:] + values[:-1]) / 2, np.diff(values)
    miss = np.searchsorted(np.sort(gp), cuts) / len(gp)
    flagged = 1 - np.searchsorted(np.sort(gu), cuts) / len(gu)
    risk = prior * miss + np.maximum(0, flagged - prior * (1 - miss))
    return float(cuts[np.argmax(np.where(risk <= risk.min() + 1e-9, gaps, -1))])


def train(pos: list[str | None], unl: list[str | None], prior: float) -> Model:
    """Without positives or without features, every score is the prior."""
    prior = float(np.clip(prior, 1e-4, 0.49))
    hashes = _choose(pos, unl) if pos else np.empty(0, np.uint32)
    if not len(hashes):
        return Model(hashes, np.empty(0), float(np.log(prior / (1 - prior))))
    model = Model(hashes, np.zeros(len(hashes)), 0.0)

    def matrix(texts: list) -> np.ndarray:
        x = np.zeros((len(texts), len(hashes) + 1), np.float32)
        x[:, -1] = 1
        for first, part in slices(texts):
            doc, feature = model.present(part)
            x[doc + first, feature] = 1
        return x

    xp, xu = matrix(pos), matrix(unl)
    fits = [_fit(xp, xu, prior, seed) for seed in range(MODELS)]
    w, b = np.mean([w for w, _ in fits], 0), float(np.mean([b for _, b in fits]))
    return Model(hashes, w, b - _threshold(xp[:, :-1] @ w + b, xu[:, :-1] @ w + b, prior))


def held_out(col: str = "doc_id"):
    """Rows whose crc32 of the id, as text, is divisible by 5 never teach; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _samples(docs: DataFrame, wanted: list[tuple[DataFrame, int, int]]) -> list[list[str | None]]:
    """For each (ids, rows, bytes): the texts of the ids with the smallest hashes, as many as fit.

    Only ids are joined and sorted; texts are fetched by a broadcast of the chosen ids, `rows` of each at most.
    """
    spark = docs.sparkSession
    picks = [[r[0] for r in ids.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(k), "doc_id"), "doc_id").limit(rows).collect()] for k, (ids, rows, _) in enumerate(wanted)]

    def only(ids) -> DataFrame:
        return docs.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")), "doc_id", "left_semi")

    sizes = only({i for p in picks for i in p}).groupBy("doc_id").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.count("*"))
    size = {r[0]: r[1] + 64 * r[2] for r in sizes.collect()}
    for k, (_, _, most) in enumerate(wanted):
        fit, held = [], 0
        for i in picks[k]:
            if held + size.get(i, 0) <= most:  # a text that does not fit is passed over
                fit.append(i)
                held += size.get(i, 0)
        picks[k] = fit
    texts: dict[int, list] = {}
    for r in only({i for p in picks for i in p}).select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    return [[t for i in p for t in sorted(texts.get(i, ()), key=lambda t: t or "")] for p in picks]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the rows of docs and labels outside the held-out fold.

    Positives are the texts of ids with a positive label, also where the id has a negative one besides. The class prior is
    the share of positive label rows, so it reads the negative labels too; nothing else does. Null labels count nowhere.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out() & F.col("doc_id").isNotNull())
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out() & F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    ids = docs.select("doc_id")
    toxic = ids.join(known.where("toxic > 0").select("doc_id"), "doc_id", "left_semi")
    pos, unl = _samples(docs, [(toxic, POSITIVES, SAMPLE_BYTES // 3), (ids, UNLABELLED, SAMPLE_BYTES * 2 // 3)])
    return train(pos, unl, prior or 0.0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of docs as a struct `row`, with its score (double, 0 to 1); null and empty texts get one score too."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))  # FEATURES weights at most

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(model.value.scores([t if isinstance(t, str) else None for t in texts]))

    return docs.select(F.struct("*").alias("row"), score("text").alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every row; repeated rows, null ids and null texts included."""
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that score 0.5 or more; columns and all other rows as they were."""
    return scored(docs, labels).where(F.col("score") < 0.5).select("row.*")

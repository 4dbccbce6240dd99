import zlib
from collections import Counter

import numpy as np
import pytest

from folioquarry.llm import ann, queries, toxicity

DOCS = "doc_id long, text string, row int, score int, lang string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(spark, n=1500):
    rng = np.random.default_rng(1)
    words = np.array(["river", "stone", "cloud", "paper", "green", "seven", "walks", "under", "house", "table"])
    docs, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 30))
        if toxic := i % 9 == 0:
            text[int(rng.integers(30))] = str(rng.choice(["vileword", "nastyone"]))
        docs.append((i, " ".join(text), 1, 2, "en"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic), "x"))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_learns_and_stays_off_the_held_out_fold(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(got) == 1500
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) == int(i % 9 == 0)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {i: r["score"] for i, r in got.items()} == {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, flipped).collect()}


def test_odd_rows_and_clean_rows_stay(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(None, "vileword", 1, 2, None), (9000, None, 1, 2, "x"), (9001, "", 1, 2, "x"), (9002, "stone " * 60_000 + "nastyone", 1, 2, "x"), (9003, "VILEWORD!!", 1, 2, "x"), (9003, "VILEWORD!!", 1, 2, "x")], DOCS)
    got = toxicity.toxicity_scores(docs.union(odd), labels)
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    assert score[9000] == score[9001] < 0.5 and min(score[9002], score[9003], score[None]) >= 0.5
    kept = toxicity.reject_toxic(docs.union(odd), labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(1500) if i % 9} | {9000, 9001}


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 50)
    assert all(r["predicted"] == 0 for r in toxicity.toxicity_scores(docs, labels.limit(0)).collect())
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op6_toxicity_nnpu(spark, sf).collect()}
    truth = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    right = np.mean([r["predicted"] == y for r, y in truth])
    false = np.mean([r["predicted"] for r, y in truth if y == 0])
    assert right > 0.95 and false < 0.02


def test_non_negative_risk_holds_back():
    x = np.eye(4, dtype=np.float32)[np.array([0] * 50 + [1] * 50)]
    x[:, 3] = 1
    w, b = toxicity._fit(x[:50], x, 0.5, 0)
    assert w[0] + b > 0 > w[1] + b


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in {i: v for i, v in ok if i % every == 0}.items():
        near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in ok if i != q)[:k]
        out[q] = near
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 900])
def test_neighbours(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 2)]) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[0][1]) for i in range(40)]  # ties
        rows += [(2000, None), (2010, [0.0] * 8), (2020, [float("nan")] + [1.0] * 7), (2030, [1.0, None] + [1.0] * 6), (2040, [1.0] * 5), (None, [1.0] * 8), (2050, [float("inf")] * 8), rows[10]]
    v = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, list int, block int")
    got = {}
    for r in ann.search(v, k=10, every=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, 10, 10)
    want = {q: w for q, w in want.items() if w}
    assert got.keys() == want.keys()
    hit = total = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & {i for _, i in want[q]})
        total += len(want[q])
    assert not total or hit / total >= 0.95


def test_recall_on_the_table(spark, sf):
    got = Counter()
    v = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in v]), np.array([r["embedding"] for r in v], float)
    found = {}
    for r in queries.op8_adaptive_scan_neighbours(spark, sf).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, d)) if k != q][:10]
        got["hit"] += sum(int(ids[k]) in found[int(ids[q])] for k in near)
        got["all"] += len(near)
        assert all(abs(s - d[np.flatnonzero(ids == i)[0]]) < 1e-9 for i, s in found[int(ids[q])].items())
    assert got["hit"] / got["all"] >= 0.9


def test_samples_pass_over_a_text_that_does_not_fit(spark):
    from pyspark.sql import functions as F

    rows = [(i, "x" * 50) for i in range(20)]
    ids = spark.createDataFrame([(i,) for i, _ in rows], "doc_id long")
    first = ids.orderBy(F.xxhash64(F.lit(0), "doc_id"), "doc_id").first()[0]
    docs = spark.createDataFrame([(i, "y" * 5000 if i == first else t) for i, t in rows], "doc_id long, text string")
    assert toxicity._samples(docs, [(ids, 20, 4000)]) == [["x" * 50] * 19]


def test_small_lists_are_topped_up(spark):
    """A query far from all others in a list of its own, and repeated rows of a query: k neighbours all the same."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 600)]
    rows += [(0, [1000.0] * 8), (0, [1000.0] * 7 + [1001.0]), (600, [-500.0] * 8)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10, every=300).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert {q: len(w) for q, w in got.items()} == {0: 10, 300: 10, 600: 10}
    near = sorted((float(np.sqrt(((np.array(v) - 1000.0) ** 2).sum())), i) for i, v in rows if i != 0)[:10]
    assert [i for _, i in sorted(got[0])][:1] == [near[0][1]] and all(i != 0 for _, i in got[0])


def plain_grams(raw: bytes) -> dict[bytes, int]:
    """The n-grams of a folded text and their hashes, one by one in plain integers."""
    m32 = 2**32 - 1

    def half(b: bytes) -> int:
        if len(b) == 1:
            return b[0]
        n = len(b)
        x = (half(b[: n // 2]) * (0x01000193 + 2 * n) + half(b[n // 2 :])) & m32
        return x ^ (x >> 15)

    out = {}
    for n in toxicity.LENGTHS:
        for k in range(len(raw) - n + 1):
            g = raw[k : k + n]
            x = ((half(g[:4]) * 0x9E3779B1 + half(g[4:n]) * 0x85EBCA77) * 0xC2B2AE3D) & m32
            x ^= x >> 16
            out[g] = x * (2 * n + 0x27D4EB2F) & m32
    return out


def test_scores_agree_with_plain_sets_of_ngrams(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    texts = [r["text"] for r in docs.collect() if len(r["text"] or "") < 3000][:60] + [None, "", "?!"]
    got = model.scores(texts)
    for text, score in zip(texts, got, strict=True):
        raw = toxicity.folded([text], 9)[0].tobytes()
        total = model.bias + sum(weight.get(h, 0.0) for h in set(plain_grams(raw).values()))
        assert abs(score - 1 / (1 + np.exp(-np.clip(total, -30, 30)))) < 1e-9
    assert len(weight) > 3 or model.bias < 0


def test_ties_among_many_copies_go_to_the_smallest_id(spark):
    rng = np.random.default_rng(9)
    one = [float(x) for x in rng.normal(size=8)]
    rows = [(0, one)] + [(1 + i, one) for i in range(150)] + [(1000 + i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    order = rng.permutation(len(rows))
    got = ann.search(spark.createDataFrame([rows[k] for k in order], "vec_id long, embedding array<double>"), k=10, every=5000).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(k, k) for k in range(1, 11)]


def test_an_id_with_both_labels_is_positive(spark):
    from pyspark.sql import functions as F

    ids = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 5]
    docs = [(i, f"calm words about rivers and stones number {i}" + (" vilegrubber nastyword" if k < 60 else "")) for k, i in enumerate(ids)]
    labels = [(i, 1) for i, _ in docs[:60]] + [(i, 0) for i, _ in docs[:200]] + [(ids[-1], None)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    bad, good = model.scores(["a vilegrubber nastyword here", "calm words about rivers"])
    assert bad >= 0.5 > good
    plain = spark.createDataFrame(labels, "doc_id long, toxic int").where(F.col("toxic").isNotNull())
    assert abs(plain.agg(F.avg("toxic")).first()[0] - 60 / 260) < 1e-9

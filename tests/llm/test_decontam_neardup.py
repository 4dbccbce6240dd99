import itertools
import random
from collections import Counter

import numpy as np
import pytest

from folioquarry.llm import decontam, fold, neardup

SCHEMA = "doc_id long, text string, n int, item_id int, key long, rep long"
WORDS = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "mel", "san", "vor", "qui") for b in ("la", "no", "ter", "x", "ming", "du", "so")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], SCHEMA)


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_folding():
    buf, ends = fold.folded(["Él  DIJO: «sí»", None, "", "..a-B"], 1)
    raw = buf.tobytes()
    parts = [raw[a:b].strip().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert parts == ["él dijo «sí»", "", "", "a b"] and all(raw[a] == 32 and raw[b - 1] == 32 for a, b in zip(ends[:-1], ends[1:], strict=True))


def test_banded_alignment_is_exact():
    rng = random.Random(5)
    for _ in range(3000):
        a = [b"%d" % rng.randint(0, 4) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at, kind = rng.randint(0, len(b)), rng.random()
            b[at : at + (kind > 0.4)] = [b"%d" % rng.randint(0, 4)] * (kind < 0.7)
        k = rng.randint(0, 10)
        assert neardup.banded(a, b, k) == min(plain_distance(a, b), k + 1)


def test_infix_distance_is_exact():
    rng = random.Random(6)
    for _ in range(1500):
        p, t = bytes(rng.choices(b"abc", k=rng.randint(1, 9))), bytes(rng.choices(b"abc", k=rng.randint(0, 20)))
        mask = {}
        for k, c in enumerate(p):
            mask[c] = mask.get(c, 0) | 1 << k
        want = min(plain_distance(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1))
        got, stop = decontam.infix(mask, len(p), t)
        assert got == want and (got == len(p) or min(plain_distance(p, t[a:stop]) for a in range(stop + 1)) == want)


def leaky(rng):
    items = [(i, " ".join(prose(rng, rng.randint(14, 60)))) for i in range(40)]
    items += [(100, "Tiny item"), (101, None), (102, ""), (103, "?!"), (104, items[3][1])]
    docs, want = [], set()
    for i in range(300):
        words = prose(rng, rng.randint(0, 200))
        if i % 5 == 0:
            item, text = items[rng.randint(0, 39)]
            own = text.split()
            if i % 10 == 0:  # changed words, other case and punctuation
                own = [rng.choice(WORDS) if rng.random() < 0.08 else w.upper() + rng.choice(["", ",", "###", " |", "\n"]) for w in own]
            at = rng.randint(0, len(words))
            words[at:at] = own
            want |= {(i, item)} | ({(i, 104)} if item == 3 else {(i, 3)} if item == 104 else set())
        docs.append((i, " ".join(words)))
    docs += [(1000, None), (1001, ""), (1002, "so it goes, tiny ITEM here"), (1003, "ba" * 50_000), (None, items[0][1]), (1004, items[1][1]), (1004, items[1][1])]
    return docs, items, want | {(1002, 100), (None, 0), (1004, 1)}


def test_leaks(spark):
    docs, items, want = leaky(random.Random(7))
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.find_leaks(frame(spark, docs), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert Counter((r["doc_id"], r["item_id"]) for r in got)[1004, 1] == 2
    assert all(r["similarity"] >= 0.8 for r in got)
    kept = decontam.decontaminate(frame(spark, docs), bench)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in docs if i not in {d for d, _ in want})
    assert kept.columns == frame(spark, []).columns


def test_leaks_agree_with_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.Index(items)
    want = set()
    for i, t in docs:
        raw = fold.folded([t], 1)[0].tobytes()
        want |= {(i, j) for j, p, m in zip(index.ids, index.texts, index.masks, strict=True) if decontam.infix(m, len(p), raw)[0] <= int(0.2 * len(p) + 1e-9)}
    from folioquarry.llm.queries import op3_cgk_decontamination

    assert {(r["doc_id"], r["item_id"]) for r in op3_cgk_decontamination(spark, sf).collect()} == want and want


@pytest.mark.parametrize("chunk", [200, 1 << 24])
def test_items_in_chunks_and_empty_tables(spark, chunk, monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK_BYTES", chunk)
    items = [(i, " ".join(prose(random.Random(i), 30))) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(i, "x " + t) for i, t in items])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()} == {(i, i) for i in range(6)}
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 == decontam.find_leaks(docs.limit(0), bench).count()
    assert decontam.decontaminate(docs, bench.limit(0)).count() == 6


def brute_groups(rows):
    words = [w.split() for w in neardup.word_lists([t for _, t in rows])]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = words[a], words[b]
        k = neardup.limit_of(len(x), len(y))
        if x == y or (x and y and sum((Counter(x) & Counter(y)).values()) >= max(len(x), len(y)) - k and neardup.banded(x, y, k) <= k):
            parent[find(b)] = find(a)
    low = {}
    for k, (i, _) in enumerate(rows):
        key = -(2**63) if i is None else i
        low[find(k)] = min(low.get(find(k), key), key)
    return Counter((i, None if low[find(k)] == -(2**63) else low[find(k)]) for k, (i, _) in enumerate(rows))


def copies(rng):
    rows = []
    for g in range(12):
        base = prose(rng, rng.randint(20, 150))
        for _ in range(rng.randint(1, 9)):
            own = [rng.choice(WORDS) if rng.random() < 0.03 else w for w in base]
            rows.append((len(rows), " ".join(own)))
    rows += [(500, None), (501, ""), (502, "?!"), (503, "one two"), (504, "One, two"), (505, "w " * 30_000), (505, "w " * 30_000), (None, rows[0][1]), (506, "ba " * 9), (507, "ba " * 10)]
    return rows


def test_groups(spark):
    rows = copies(random.Random(8))
    got = neardup.near_groups(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_groups(rows)
    kept = neardup.keep_one(frame(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({g for _, g in brute_groups(rows)}, key=str) and kept.columns == frame(spark, []).columns


def test_groups_of_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = neardup.near_groups(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_groups(rows)


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_hot_buckets_go_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    shared, rows = prose(rng, 60), []
    for g in range(15):  # one long passage in texts that differ, each with near copies
        own = prose(rng, 25)
        rows += [(len(rows) + k, " ".join([*shared, *own[:24], f"copy{k}"])) for k in range(5)]
    got = neardup.near_groups(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == brute_groups(rows)


@pytest.mark.parametrize("block", [1, 2048])
def test_chains_are_not_broken(spark, block, monkeypatch):
    """Ten chains of texts, each linked to the next only; the ends are far apart, and all share a passage."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(12)
    passage, rows = prose(rng, 60), []
    for c in range(10):
        own = prose(rng, 40)
        for step in range(4):  # 16 of 100 words more are other ones at each step
            rows.append((rng.randrange(10**6), " ".join([*passage, *(f"c{c}x{k}" if k < 13 * step else w for k, w in enumerate(own))])))
    rng.shuffle(rows)
    want = brute_groups(rows)
    got = neardup.near_groups(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want


@pytest.mark.parametrize("n", [5, 6, 8, 10, 15, 20, 30, 39, 40, 41, 50, 60, 100, 200, 300])
def test_recall_at_the_limit_by_length(n):
    """Pairs of n words with as many changed words, at random places, as the limit allows: a sketch in common."""
    rng = random.Random(n)
    found = 0
    for _ in range(300):
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for k in rng.sample(range(n), neardup.limit_of(n, n)):
            b[k] = f"v{rng.randrange(10**6)}"
        buf, ends = fold.folded([" ".join(a), " ".join(b)], 0)
        begins, hashes = neardup.word_hashes(buf)
        cut = int(np.searchsorted(begins, ends[1]))
        found += bool(set(neardup.sketch(hashes[:cut]).tolist()) & set(neardup.sketch(hashes[cut:]).tolist()))
    assert found >= 270


def test_lengths_on_both_sides_of_the_two_kinds_of_sketch():
    """A text just below SHORTEST_LONG words against a longer linked one: both have the short kind."""
    words = [f"w{k}" for k in range(48)]
    cut = [w for k, w in enumerate(words) if k % 5]  # 38 words
    buf, ends = fold.folded([" ".join(words), " ".join(cut)], 0)
    begins, hashes = neardup.word_hashes(buf)
    at = int(np.searchsorted(begins, ends[1]))
    assert set(neardup.sketch(hashes[:at]).tolist()) & set(neardup.sketch(hashes[at:]).tolist())
    for n in range(1, 120):
        assert all(n >= neardup.SHORTEST_LONG or m <= neardup.LONGEST_SHORT for m in range(n, 130) if m - n <= neardup.limit_of(m, n))


def test_word_hashes_tell_words_apart():
    rng = random.Random(13)
    texts = [" ".join(prose(rng, 50)) for _ in range(20)] + ["", None, "a", "a a b ab ba"]
    buf, ends = fold.folded(texts, 0)
    begins, hashes = neardup.word_hashes(buf)
    words = [w for t in neardup.word_lists(texts) for w in t.split()]
    assert len(words) == len(hashes) and len({*zip(words, hashes.tolist(), strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


def test_no_rows(spark):
    assert neardup.near_groups(frame(spark, [])).count() == 0 == neardup.keep_one(frame(spark, [])).count()


def test_keep_one_tells_texts_of_one_id_apart(spark):
    rng = random.Random(10)
    texts = [" ".join(prose(rng, 40)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[1].upper()), (7, texts[2]), (7, texts[3]), (8, texts[4])]
    rows += [(9, texts[4] + " so"), (9, texts[5]), (8, None), (None, "")]  # id 9 holds a near copy of 8 and a text of its own
    kept = neardup.keep_one(frame(spark, rows)).collect()
    words = Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept)
    assert words == Counter([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4]), (9, texts[5]), (None, "")])


@pytest.mark.parametrize("n", [5, 8, 12, 16, 20, 40, 100, 300])
@pytest.mark.parametrize("share", [0.1, 0.15, 0.2])
def test_recall_of_edited_items_by_length(n, share):
    """Items of n words with random characters changed, put in or taken out, of all that brute force finds within the limit."""
    rng = random.Random(n)
    items = [(i, " ".join(prose(rng, n))) for i in range(60)]
    docs = []
    for k, (_, t) in enumerate(items):
        chars = list(t)
        for p in rng.sample(range(len(t)), int(share * len(t) + 1e-9)):
            kind = rng.random() if k % 2 else 0.0
            chars[p] = rng.choice("aeiou xyz") if kind < 0.5 else "" if kind < 0.75 else chars[p] + rng.choice("aeiou xyz")
        docs.append(" ".join([*prose(rng, 40), "".join(chars), *prose(rng, 20)]))
    index = decontam.Index(items)
    want = set()
    for d, text in enumerate(docs):
        raw = fold.folded([text], 1)[0].tobytes()
        if decontam.infix(index.masks[d], len(index.texts[d]), raw)[0] <= index.most[d]:
            want.add((d, d))
    got = {(d, i) for d, i, *_ in index.leaks(docs)}
    assert len(want & got) >= 0.9 * len(want) > 40


@pytest.mark.parametrize("size", [20, 40, 60, 80, 100, 200])
def test_word_changes_at_any_place(size):
    rng = random.Random(size)
    items = [(i, " ".join(prose(rng, size))[:size].strip()) for i in range(30)]
    docs, own = [], []
    for k, (_, t) in enumerate(items):
        first, one = t.split(), t.split()
        first[0], one[rng.randrange(len(one))] = "zq", rng.choice(WORDS)
        docs += [" ".join([*prose(rng, 30), *w, *prose(rng, 9)]) for w in (first, one)]
        docs += [" ".join([*prose(rng, 30), t[:-3]]), t[2:]]  # at the end and at the start of a document
        own += [k] * 4
    index = decontam.Index(items)
    got = {(d, i) for d, i, *_ in index.leaks(docs)}
    want = {(d, k) for d, k in enumerate(own) if decontam.infix(index.masks[k], len(index.texts[k]), fold.folded([docs[d]], 1)[0].tobytes())[0] <= index.most[k]}
    assert len(want & got) >= 0.9 * len(want)


def test_short_windows_over_lanes_are_exact():
    rng = random.Random(14)
    items = [(i, " ".join(prose(rng, rng.randint(1, 10)))[:64].strip()) for i in range(40)]
    index = decontam.Index(items)
    buf, ends = fold.folded([" ".join(prose(rng, 400))], 1)
    raw = buf.tobytes()
    item = np.array([rng.randrange(40) for _ in range(500)])
    lo = np.array([rng.randrange(len(buf)) for _ in item])
    hi = np.minimum(lo + np.array([rng.randrange(90) for _ in item]), len(buf))
    want = [decontam.infix(index.masks[i], len(index.texts[i]), raw[a:z])[0] <= index.most[i] for i, a, z in zip(item.tolist(), lo.tolist(), hi.tolist(), strict=True)]
    assert index._near(item, lo, hi, buf).tolist() == want


def test_hot_places_go_in_parts(monkeypatch):
    """A beginning that all items share votes for each of them; held in parts it gives the same."""
    rng = random.Random(15)
    lead = " ".join(prose(rng, 12))
    items = [(i, lead + " " + " ".join(prose(rng, 20))) for i in range(50)]
    docs = [" ".join([*prose(rng, 10), items[k][1], lead, lead]) for k in range(20)]
    index = decontam.Index(items)
    whole = sorted(index.leaks(docs))
    monkeypatch.setattr(decontam, "MOST_HITS", 50)
    assert sorted(index.leaks(docs)) == whole and {(d, i) for d, i, *_ in whole} == {(k, k) for k in range(20)}


def test_items_without_blanks():
    rng = random.Random(16)
    letters = [chr(0x4E00 + k) for k in range(400)]
    items = [(i, "".join(rng.choices(letters, k=40))) for i in range(20)]
    docs = ["".join([*rng.choices(letters, k=100), *(rng.choice(letters) if rng.random() < 0.05 else c for c in t), *rng.choices(letters, k=50)]) for _, t in items]
    assert {(d, i) for d, i, *_ in decontam.Index(items).leaks(docs)} == {(k, k) for k in range(20)}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_repeated_keys_across_ranges(spark, parts):
    rng = random.Random(17)
    rows = [(rng.choice([5, 6, -9, *range(100, 400)]), rng.randrange(40), 7) for _ in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = neardup._repeated(spark.createDataFrame(rows, "key long, id long, n int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = {}
    for k, i, _ in rows:
        ids.setdefault(k, set()).add(i)
    want = {(k, i) for k, own in ids.items() if len(own) > 1 for i in own}
    found = {(r["key"], r["id"]) for r in got}
    assert want <= found and len(found - want) <= 2 * parts
    assert neardup._repeated(spark.createDataFrame([], "key long, id long, n int")).count() == 0

"""MinHash near-dedup with Order MinHash, verified by banded alignment.

A text is its sequence of folded words (see fold.py). Texts with equal sequences form a class, and only one text of each
class goes on. An Order MinHash sketch (Marcais et al., 2019) takes, under each of SKETCHES hash functions, the PICKS
smallest five-word k-mers, labelled with their occurrence number, and keeps them in text order; so equal sketches ask for
shared k-mers in the same order, and their chance follows the edit similarity. Two texts are candidates when one sketch
is equal; they are linked when the edit distance of their word sequences, aligned within a band, is at most
(1 - SIMILARITY) of the longer one. Short texts with an edit in every fifth word have hardly a five-word k-mer in common:
texts of at most LONGEST_SHORT words have SHORT_SKETCHES sketches of two-word k-mers (texts of at least SHORTEST_LONG words
the five-word ones; as linked lengths differ by a quarter at most, any linked pair has sketches of one kind in common).
At exactly the limit with edits at random places a pair of any length is found with a chance of over 0.9 (measured by
length in the tests), and nearer pairs more often.

A bucket of equal sketches is never expanded into all its pairs of rows. First each member is aligned with the bucket's
smallest id (the pivot), up to the distance beyond which it cannot be linked to anything that is linked to the pivot.
Components of the links found so far are contracted, and buckets that hold one component only are done; that is where large
groups of near copies end. What is left goes in blocks of BLOCK texts, every two blocks of a bucket meeting in one task:
a pair is looked at in the first bucket that it shares, if it is not connected yet, its lengths allow a link, and its known
distances to the pivot do (the triangle inequality). A first pass does so on sketches alone and tells which texts are
needed; a second one has their words, rules pairs out by the words they have in common, aligns the others, and gives links
only. So no link between candidates is lost, memory is bounded by the block, and a group is spread over tasks; the work for
texts that share a long passage and lie just off the limit remains in the square of their number, cheap as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioquarry.llm.common import discard, id_back, id_key, mark, release, tidy, written
from folioquarry.llm.fold import folded, slices

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS = 96, 2
SHORT_SHINGLE, SHORT_SKETCHES = 2, 48
SHORTEST_LONG, LONGEST_SHORT = 40, 50
#: Texts, and words, that a block of a bucket holds on average at most.
BLOCK, BLOCK_WORDS = 2048, 2_000_000
BROADCAST_ROWS = 1_000_000
#: Classes that a task remembers.
MEMO = 100_000
_LINKED, _RING, _APART = 0, 1, 2
_CELLS, _STRETCH = 1 << 18, 1 << 18
_RNG = np.random.default_rng(2019)
_ODD = _RNG.integers(0, 2**31, SKETCHES + SHORT_SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALT = _RNG.integers(1, 2**63, SKETCHES + SHORT_SKETCHES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PASS = "id long, own long, c1 long, c2 long, n int, sketch array<long>"
#: A polynomial hash of words over a ring of 64 bits: values of the bytes, the base and its inverse.
_BYTES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of folded bytes begin, and a 64-bit hash of each; in stretches that end with a word."""
    blank = buf == 32
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    if len(ends) < len(begins):
        ends = np.append(ends, len(buf))
    out = np.empty(len(begins), np.uint64)
    cuts = np.unique(np.searchsorted(begins, np.arange(0, len(buf) + _STRETCH, _STRETCH)))
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = buf[begins[first] : ends[last - 1]]
        a, z = begins[first:last] - begins[first], ends[first:last] - begins[first]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[own] * _powers(_BASE, len(own)))])
        out[first:last] = (sums[z] - sums[a]) * _powers(_INVERSE, len(own))[a] + (z - a).astype(np.uint64)
    return begins, _mixed(out)


def _picked(words: np.ndarray, k: int, at: int, count: int) -> np.ndarray:
    """The order min-hashes of functions at .. at + count - 1 over k-mers of k words."""
    k = min(k, len(words))
    h = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        h = _mixed(h) + words[j : len(words) - k + 1 + j]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():  # label repeated k-mers with their occurrence number
        run = np.concatenate([[0], np.cumsum(~same)])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        nth = np.arange(len(h)) - first[run]
        h[order] += nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = _mixed(h)
    low = (h >> np.uint64(32)).astype(np.uint32)
    first, second = np.zeros(count, np.int64), np.zeros(count, np.int64)
    step = max(1, min(count, _CELLS // len(h)))
    for a in range(0, count if len(h) > 1 else 0, step):
        keys = low[None, :] * _ODD[at + a : at + min(a + step, count), None]
        first[a : a + step] = own = keys.argmin(1)
        keys[np.arange(len(keys)), own] = np.iinfo(np.uint32).max
        second[a : a + step] = keys.argmin(1)
    left, right = np.minimum(first, second), np.maximum(first, second)
    return _mixed(_mixed(h[left]) * np.uint64(3) + h[right] + _SALT[at : at + count])


def sketch(words: np.ndarray) -> np.ndarray:
    """The order min-hashes of a sequence of word hashes, of five-word k-mers, then of two-word ones; none for an empty sequence."""
    parts = [np.empty(0, np.uint64)]
    if len(words) >= SHORTEST_LONG:
        parts.append(_picked(words, SHINGLE, 0, SKETCHES))
    if 0 < len(words) <= LONGEST_SHORT:
        parts.append(_picked(words, SHORT_SHINGLE, SKETCHES, SHORT_SKETCHES))
    return np.concatenate(parts).view(np.int64)


def word_lists(texts: list[str | None]) -> Iterator[bytes]:
    """The folded bytes of each text; split() gives its words."""
    for _, part in slices(texts):
        buf, ends = folded(part, 0)
        raw = buf.tobytes()
        yield from (raw[a:b].strip() for a, b in zip(ends[:-1], ends[1:], strict=True))


def _first_pass(docs: DataFrame) -> DataFrame:
    """Per row the hash and the number of its words, and its sketch; copies within a task need no second one (empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def of(whole: int, words: np.ndarray) -> np.ndarray:
            if whole in seen:
                return np.empty(0, np.int64)
            if len(seen) >= MEMO:
                seen.clear()
            seen.add(whole)
            return sketch(words)

        for b in batches:
            at = 0
            for _, part in slices(b.column(1).to_pylist()):
                buf, ends = folded(part, 0)
                raw = buf.tobytes()
                begins, hashes = word_hashes(buf)
                cuts = np.searchsorted(begins, ends)
                whole = [xxhash.xxh3_128_intdigest(raw[a:z].strip()) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                flat = [of(w, hashes[a:z]) for w, a, z in zip(whole, cuts[:-1], cuts[1:], strict=True)]
                signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                c1, c2 = signed([w >> 64 for w in whole]), signed([w & (2**64 - 1) for w in whole])
                sizes = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(flat), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), b.column(2).slice(at, len(part)), c1, c2, pa.array(np.diff(cuts).astype(np.int32)), lists], names=["id", "own", "c1", "c2", "n", "sketch"])
                at += len(part)

    return docs.mapInArrow(run, _PASS)


def limit_of(m: int, n: int) -> int:
    return int((1 - SIMILARITY) * max(m, n) + 1e-9)


def banded(a: list[bytes], b: list[bytes], k: int) -> int:
    """The edit distance of two sequences if it is at most k, else k + 1: bit vectors of one band of 2k + 1 rows (Hyyro, 2003)."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    m, n = len(a), len(b)
    if abs(m - n) > k:
        return k + 1
    if not m or not n:
        return max(m, n)
    k_band = min(k, max(m, n))
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    width = 2 * k_band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, score = full ^ ((1 << k_band) - 1), 0, min(k_band, m)
    row = m - k_band  # the band's last row is row j + k_band up to column m - k_band
    for j in range(1, n + 1):
        eq = where.get(b[j - 1], 0)
        low = j - k_band - 1
        eq = (eq >> low if low >= 0 else eq << -low) & full
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if j <= row:
            score += not d0 & top
            if score - (k_band + n - m) > k:
                return k + 1
        else:
            bit = 1 << (m - j + k_band)
            score += bool(hp & bit) - bool(hn & bit)
        vp = hn | (full & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
    return score if score <= k else k + 1

def _common(x: list[bytes], y: list[bytes]) -> int:
    """How many words two sequences have in common, with repeats."""
    counts: dict[bytes, int] = {}
    for w in x:
        counts[w] = counts.get(w, 0) + 1
    common = 0
    for w in y:
        if c := counts.get(w, 0):
            counts[w] = c - 1
            common += 1
    return common


def relate(a: bytes, b: bytes) -> tuple[int, int]:
    """How a pivot a and a member b stand: (_LINKED, _RING or _APART; their distance, or one more than was looked for)."""
    x, y = a.split(), b.split()
    near = limit_of(len(x), len(y))
    far = int(0.25 * len(x) + (1 - SIMILARITY) * max(len(y), 1.25 * len(x))) + 1  # beyond it nothing inside the limit of a links to b
    if max(len(x), len(y)) - _common(x, y) > far:
        return _APART, far + 1
    d = banded(x, y, far)
    return (_LINKED if d <= near else _RING if d <= far else _APART), d


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, state, d) of pairs (a, b) of pivots and members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [relate(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for s, _ in got], pa.int32()), pa.array([d for _, d in got], pa.int32())], names=["a", "b", "state", "d"])

    left = texts.select(F.col("id").alias("a"), F.col("folded").alias("fa"))
    right = texts.select(F.col("id").alias("b"), F.col("folded").alias("fb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "fa", "fb")
    return written(both.mapInArrow(run, "a long, b long, state int, d int"), "near-verified")


def _near_pivot(n: Column, m: Column) -> Column:
    """Lengths of a pivot (n) and a member (m) at which the member may be linked or in the ring, as in relate()."""
    return F.abs(n - m) <= F.floor(n * F.lit(0.25) + F.greatest(m.cast("double"), n * F.lit(1.25)) * F.lit(1 - SIMILARITY)) + 1


def _stars(buckets: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified pairs (a, b) of pivots and members; and (key, id, n, exact, d) of all members: their distance to the pivot, or a lower bound of it."""
    pivots = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"))
    stars = buckets.join(pivots, "key").where(F.col("id") != F.col("p.id"))
    stars = stars.select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
    found = _verify(stars.where(_near_pivot(F.col("na"), F.col("nb"))).select("a", "b").distinct(), texts)
    known = stars.join(found, ["a", "b"], "left")
    return found, known.select("key", F.col("b").alias("id"), F.col("nb").alias("n"), F.coalesce(F.col("state") != _APART, F.lit(False)).alias("exact"), F.coalesce("d", F.abs(F.col("na") - F.col("nb"))).alias("d"))


_BLOCKS = "key long, i int, j int, own int, id long, n int, root long, exact boolean, d int"


def _small(df: DataFrame) -> DataFrame:
    """A written table of ids: broadcast up to BROADCAST_ROWS rows (of 16 bytes or so), else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _with_sketches(texts: DataFrame) -> DataFrame:
    """(id, folded, sketch) of (id, folded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = [sketch(word_hashes(np.frombuffer(b" " + t, np.uint8))[1]) for t in b.column(1).to_pylist()]
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, np.int64), *flat]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["id", "folded", "sketch"])

    return texts.select("id", "folded").mapInArrow(run, "id long, folded binary, sketch array<long>")


def _blocks(known: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, once for every two blocks (i, j) of their bucket that they belong to."""
    known = written(known.join(_small(roots), "id", "left").withColumn("root", F.coalesce("root", "id")), "near-known")
    sizes = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows"), F.sum("n").alias("words")).where("lo < hi")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    members = written(known.join(sizes.select("key", blocks.alias("blocks")), "key"), "near-members")
    ids = written(members.select("id").distinct(), "near-ids")
    sketches = _with_sketches(texts.join(_small(ids), "id", "left_semi")).select("id", "sketch")
    members = members.join(sketches, "id").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "root", "exact", "d", "sketch")


def _groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that lie side by side with equal first three columns, group by group."""
    held, current = [], None
    for b in batches:
        keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if a == z:
                continue
            if held and (key := tuple(keys[a])) != current:
                yield pa.Table.from_batches(held)
                held = []
            current = tuple(keys[a])
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _in_groups(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _candidates(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group that have to be looked at here; a function of the two rows alone."""
    col = {c: t.column(c).to_numpy() for c in ("key", "i", "j", "own", "n", "root", "exact", "d")}
    sketches, sizes = _matrix(t, col["n"])
    order = np.argsort(col["n"], kind="stable")
    n, root, exact, d, own = (col[c][order] for c in ("n", "root", "exact", "d", "own"))
    n, d, sketches = n.astype(np.int64), d.astype(np.int64), sketches[order]
    here = int(np.flatnonzero(sketches[0] == col["key"][0])[0])
    across = bool(col["i"][0] != col["j"][0])
    longest = np.floor(n / SIMILARITY + 1e-6).astype(np.int64)
    last = np.searchsorted(n, longest, "right")
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, _CELLS // max(1, len(n)))
    for a in range(0, len(n) - 1, step):
        rows, cols = np.arange(a, min(a + step, len(n))), np.arange(a + 1, last[min(a + step, len(n)) - 1])
        if not len(cols):
            continue
        x, y = rows[:, None], cols[None, :]
        most = np.floor((1 - SIMILARITY) * n[y] + 1e-9)
        gap = d[x] - d[y]
        bound = np.where(exact[x], np.where(exact[y], np.abs(gap), -gap), np.where(exact[y], gap, 0))
        ok = (y > x) & (root[x] != root[y]) & (n[y] - n[x] <= most) & (bound <= most)
        if across:
            ok &= own[x] != own[y]
        x, y = np.nonzero(ok)
        x, y = rows[x], cols[y]
        for b in range(0, len(x), 4096):
            equal = sketches[x[b : b + 4096]] == sketches[y[b : b + 4096]]
            first = equal.argmax(1) == here
            left.append(x[b : b + 4096][first])
            right.append(y[b : b + 4096][first])
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _matrix(t: pa.Table, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of each row side by side; what a text has none of is filled with values that no other row has."""
    lists = t.column("sketch").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(np.arange(len(n))[:, None], SKETCHES + SHORT_SKETCHES, 1)
    long, short = n >= SHORTEST_LONG, n <= LONGEST_SHORT
    for rows, offset, first, count in ((long, 0, 0, SKETCHES), (short & ~long, 0, SKETCHES, SHORT_SKETCHES), (short & long, SKETCHES, SKETCHES, SHORT_SKETCHES)):
        k = np.flatnonzero(rows)
        out[k, first : first + count] = flat[at[k][:, None] + offset + np.arange(count)[None, :]]
    return out, sizes


def _needed(blocks: DataFrame) -> DataFrame:
    """The rows of blocks that are part of a pair to look at, without their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups_of(batches):
            left, right = _candidates(t)
            if len(left):
                yield from t.drop_columns(["sketch"]).take(pa.array(np.unique(np.concatenate([left, right])))).to_batches()

    return _in_groups(blocks).mapInArrow(run, _BLOCKS)


def _overlaps(words: list[list[bytes]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The words that the texts of each pair have in common, with repeats; by rows over an inverted index."""
    codes: dict[tuple[bytes, int], int] = {}
    tokens = []
    for own in words:
        seen: dict[bytes, int] = {}
        mine = []
        for w in own:
            nth = seen[w] = seen.get(w, 0) + 1
            mine.append(codes.setdefault((w, nth), len(codes)))
        tokens.append(np.array(mine, np.int64))
    sizes = [len(x) for x in tokens]
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(words)), sizes)
    order = np.argsort(flat, kind="stable")
    holders, at = owner[order], np.searchsorted(flat[order], np.arange(len(codes) + 1))
    out = np.zeros(len(left), np.int64)
    by = np.argsort(left, kind="stable")
    cuts = np.flatnonzero(np.diff(left[by])) + 1
    for own in np.split(by, cuts):
        mine = tokens[int(left[own[0]])]
        lo, n = at[mine], at[mine + 1] - at[mine]
        rows = holders[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
        out[own] = np.bincount(rows, minlength=len(words))[right[own]]
    return out


def _links_in(t: pa.Table) -> Iterator[tuple[int, int]]:
    """The links of a group that connect components which nothing in the group has connected before."""
    left, right = _candidates(t)
    if not len(left):
        return
    ids, root = t.column("id").to_pylist(), t.column("root").to_pylist()
    words = [x.split() for x in t.column("folded").to_pylist()]
    most = np.array([limit_of(len(words[x]), len(words[y])) for x, y in zip(left.tolist(), right.tolist(), strict=True)])
    longer = np.array([max(len(words[x]), len(words[y])) for x, y in zip(left.tolist(), right.tolist(), strict=True)])
    if len(left) > 64:
        common = _overlaps(words, left, right)
    else:
        common = np.array([_common(words[x], words[y]) for x, y in zip(left.tolist(), right.tolist(), strict=True)])
    slack = most - (longer - common)
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for k in np.argsort(-slack / longer, kind="stable").tolist():  # the likeliest first: what they connect needs no further look
        if slack[k] < 0:
            break
        x, y, limit = int(left[k]), int(right[k]), int(most[k])
        if (a := find(root[x])) != (b := find(root[y])) and banded(words[x], words[y], limit) <= limit:
            parent[a] = b
            yield min(ids[x], ids[y]), max(ids[x], ids[y])


def _more_links(needed: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups_of(batches):
            if found := list(_links_in(t)):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    ids = written(needed.select("id").distinct(), "near-ids")
    texts = _with_sketches(texts.join(_small(ids), "id", "left_semi"))
    both = needed.join(texts, "id").select("key", "i", "j", "own", "id", "n", "root", "exact", "d", "sketch", "folded")
    return written(_in_groups(both).mapInArrow(run, "a long, b long"), "near-more")


def _links(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a < b: linked pairs that connect what the buckets connect; texts are (id, folded)."""
    start = mark()
    found, known = _stars(buckets, texts)
    first = written(found.where(F.col("state") == _LINKED).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-links")
    release(texts.sparkSession)
    roots = _groups(first)
    needed = written(_needed(_blocks(known, roots, texts)), "near-blocks")
    release(texts.sparkSession)
    links = written(first.union(_more_links(needed, texts)).distinct(), "near-links")
    tidy(texts.sparkSession, start, links)
    return links


def _groups(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id of the connected component, for every id that has a link.

    Each round every id goes to the smallest of itself and its neighbours, and edges are drawn between those; what has become
    one point has no edge any more, so a hot group is gone after the first round. Rounds are written tables.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct()
    edges = written(edges, "near-edges")
    where = None
    while True:
        step = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "near-step")
        if where is None:
            moved = step.select(F.col("u").alias("id"), F.col("to").alias("root"))
        else:
            moved = where.join(step, where.root == step.u, "left").select("id", F.coalesce("to", "root").alias("root"))
        after = written(moved, "near-labels")
        onward = edges.join(step, "u").select("v", F.col("to").alias("from")).join(step.select(F.col("u").alias("v"), "to"), "v")
        onward = written(onward.where("from <> to").select(F.col("from").alias("u"), F.col("to").alias("v")).distinct(), "near-edges")
        discard(edges, step, *([] if where is None else [where]))
        where, edges = after, onward
        if edges.isEmpty():
            discard(edges)
            return where


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, copy_id (smallest id with the same words), class_id (smallest id of its group).

    Texts without a word (null, empty, punctuation) are one class. Repeated rows and ids give repeated rows; a null id is
    kept and sorts first; an empty table gives an empty result; other columns are not read.
    """
    out = _grouped(docs)
    return out.select(id_back(F.col("id")).alias("doc_id"), id_back(F.col("rep")).alias("copy_id"), id_back(F.coalesce("group", "rep")).alias("class_id"))


def _once(rows: DataFrame, *key: str) -> DataFrame:
    """One of the rows of each key; those that stand alone (times = 1) are not sorted."""
    return rows.where("times = 1").unionByName(rows.where("times > 1").dropDuplicates(list(key)))


def _grouped(docs: DataFrame) -> DataFrame:
    """One row per input row: id, own (hash of its text), rep and group (ids, as in near_groups), root.

    Ids can stand for several texts or be null; root is the class of words that stands for the whole component.
    """
    spark = docs.sparkSession
    source = docs.select(id_key().alias("id"), "text", F.xxhash64("text").alias("own"))
    first = written(_first_pass(source), "near-sketches")
    counts = first.groupBy("c1", "c2", "id").agg(F.count("*").alias("times"), F.min("n").alias("n"))
    classes = counts.groupBy("c1", "c2").agg(F.min(F.struct("id", "times")).alias("rep"), F.min("n").alias("n"))
    classes = written(classes.select("c1", "c2", F.xxhash64("c1", "c2").alias("cid"), F.col("rep.id").alias("rep"), F.col("rep.times").alias("times"), "n"), "near-classes")
    rows = written(first.select("id", "own", "c1", "c2").join(classes.select("c1", "c2", "cid", "rep"), ["c1", "c2"]).select("id", "own", "cid", "rep"), "near-rows")
    keys = first.select(F.xxhash64("c1", "c2").alias("id"), "n", F.explode("sketch").alias("key"))
    buckets = written(_repeated(keys), "near-buckets")
    discard(first)

    ids = written(buckets.select("id").distinct(), "near-ids")
    wanted = written(classes.join(_small(ids), classes.cid == ids.id, "left_semi").select("cid", F.col("rep").alias("id"), "times", "c1", "c2"), "near-wanted")
    texts = written(_candidate_texts(source.select("id", "text"), wanted), "near-texts")
    reps = written(classes.join(_small(ids), classes.cid == ids.id, "left_semi").select(F.col("cid").alias("id"), "rep"), "near-reps")
    discard(classes, wanted)
    links = _links(buckets, texts)
    discard(buckets, texts)
    named = _groups(links).join(reps, "id")
    lowest = named.groupBy("root").agg(F.min("rep").alias("group"))
    info = named.join(lowest, "root").select(F.col("id").alias("cid"), "root", "group")
    return rows.join(info, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def _repeated(keys: DataFrame) -> DataFrame:
    """The rows (key, id, n) whose key several ids have, each once: neighbours in one sort, which cuts hot keys into ranges.

    The first and the last key of a range are kept in any case; such a key may have one id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.array(rows[2].astype(np.int32))], names=["key", "id", "n"])

        last, stays = None, True
        for b in batches:
            rows = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(3)])
            rows = rows if last is None else np.concatenate([last, rows], 1)
            rows = rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(0)])] if rows.shape[1] else rows
            if not rows.shape[1]:
                continue
            same = rows[0, 1:] == rows[0, :-1]
            keep = np.concatenate([[stays], same]) | np.concatenate([same, [False]])
            yield batch(rows[:, :-1][:, keep[:-1]])
            last, stays = rows[:, -1:], bool(keep[-1])
        if last is not None:
            yield batch(last)

    ordered = keys.select("key", "id", "n").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    return ordered.mapInArrow(run, "key long, id long, n int")


def _candidate_texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, folded) of the representatives; an id with several rows is told apart by the hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, c1, c2, at = *(b.column(k).to_pylist() for k in (0, 2, 3)), 0
            for _, part in slices(b.column(1).to_pylist()):
                keys, out = [], []
                for k, text in enumerate(word_lists(part), at):
                    whole = xxhash.xxh3_128_intdigest(text)
                    if (c1[k] % 2**64, c2[k] % 2**64) == (whole >> 64, whole & (2**64 - 1)):
                        keys.append(k)
                        out.append(text)
                at += len(part)
                times = b.column(4).take(pa.array(keys, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keys], pa.int64()), pa.array(out, pa.binary()), times], names=["id", "folded", "times"])

    found = source.join(_small(wanted), "id").select("cid", "text", "c1", "c2", "times").mapInArrow(run, "id long, folded binary, times long")
    return _once(found, "id").drop("times")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest id, then of the smallest hash of its text; of equal rows one."""
    counts = _grouped(docs).groupBy("root", "id", "own").agg(F.count("*").alias("n"))
    chosen = counts.groupBy("root").agg(F.min(F.struct("id", "own", "n")).alias("k"))
    chosen = written(chosen.select(F.col("k.id").alias("_id"), F.col("k.own").alias("_own"), F.col("k.n").alias("n")), "near-chosen")
    rows, key = docs.select(F.struct("*").alias("row"), id_key().alias("_id"), F.xxhash64("text").alias("_own")), ["_id", "_own"]
    out = rows.join(chosen.where("n = 1"), key, "left_semi").select("row")
    several = chosen.where("n > 1")
    if not several.isEmpty():
        nth = F.row_number().over(W.partitionBy(*key).orderBy("row.text"))
        more = rows.join(several, key, "left_semi").withColumn("_nth", nth).where("_nth = 1").select("row")
        out = out.unionByName(more)
    return out.select("row.*")

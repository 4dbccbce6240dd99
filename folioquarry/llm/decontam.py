"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

The CGK walk (Chakraborty, Goldenberg and Koucky, 2016) reads a string with one pointer: step j emits the character under
it and moves on by a random bit of (j, character). Two walks with the same bits fall into step again after an edit, so
edit distance becomes Hamming distance between the emitted strings. One hash function of the LSH reads a few sampled
positions of a walk; a family of functions repeats that with bits and samples of its own.

Walks begin at every word (and at every character of three bytes or more, as in scripts without blanks), in the items and
in the documents alike. An item-sized window of a document is one start of the item, give or take the edits that the limit
allows; each walk in it that agrees with the item's walk from the same place is a vote for it. At the limit, one place agrees
with the chance that CHANCE states for its family (measured, with edits at random places), so the number of votes that a
window needs is the largest, up to MOST_VOTES, that an item of so many places reaches with a chance of RECALL. Items of
less than SHORT bytes have few places; their walks are shorter and more, and one vote is enough.

A window with enough votes is verified exactly: the item matches if its edit distance to some substring is at most
(1 - SIMILARITY) of its length. Windows with too few of the item's trigrams cannot match (an edit takes three at most); the
others go through Myers' bit-parallel algorithm, for items of one machine word over all windows at once. Distances are over
folded text (see fold.py), in bytes.

Documents are read once and never shuffled. The items travel in chunks of CHUNK_BYTES (measured first), with one pass over
the documents for each chunk. Places that many items share give a vote to each of them; MOST_HITS bounds how many are held
at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import id_key, written
from folioquarry.llm.fold import folded, slices

SIMILARITY = 0.8
SHORT = 64
RECALL, MOST_VOTES = 0.97, 6
CHUNK_BYTES = 16 << 20
MOST_HITS, LANES = 1 << 22, 1 << 15
BROADCAST_ROWS = 1_000_000
_FILTER_BITS = 18
_GRAMS = 1 << 11
_LEAK = "doc_id long, item_id long, distance int, similarity double, start int, stop int"


@dataclass(frozen=True)
class Family:
    """Walks of `steps` steps with `sampled` positions each; chance: that one of `repeats` agrees at one place of a match at the limit."""

    steps: int
    sampled: int
    repeats: int
    chance: float

    def walks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each repeat: the bits of (step, byte), and which steps are sampled."""
        for k in range(self.repeats):
            rng = np.random.default_rng([k, self.steps])
            yield rng.integers(0, 2, (self.steps, 256)).astype(np.int32), np.sort(rng.choice(self.steps, self.sampled, replace=False))


FAMILIES = {True: Family(16, 6, 8, 0.6), False: Family(32, 8, 6, 0.38)}


def signatures(buf: np.ndarray, at: np.ndarray, bits: np.ndarray, sampled: np.ndarray, filters: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The sampled positions of the walks from each place, hashed: (which places, hashes, hashes on the way).

    With filters, walks whose samples on the way no item has are left off. Every walk must fit into buf.
    """
    i, h, rows, on_way = at.astype(np.int32), np.zeros(len(at), np.uint32), np.arange(len(at)), []
    checks = {int(sampled[len(sampled) // 2 - 1]): 0, int(sampled[-2]): 1}
    wanted = set(sampled.tolist())
    for j in range(int(sampled[-1]) + 1):
        c = np.take(buf, i)
        if j in wanted:
            h = (h ^ c) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        i += np.take(bits[j], c)
        if j in checks:
            mixed = h * np.uint32(0x9E3779B1)
            on_way.append(mixed)
            if filters is not None:
                go = np.flatnonzero(np.take(filters[checks[j]], mixed >> np.uint32(32 - _FILTER_BITS)))
                i, h, rows = i[go], h[go], rows[go]
    return rows, h * np.uint32(0x9E3779B1), on_way


def _bitmap(h: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[h >> np.uint32(32 - _FILTER_BITS)] = True
    return seen


def places(buf: np.ndarray) -> np.ndarray:
    """Where walks begin: at words, and at characters of three bytes or more."""
    out = (buf != 32) & ((buf >= 0xE0) | (np.concatenate([[32], buf[:-1]]) == 32))
    return np.flatnonzero(out)


def _trigrams(buf: np.ndarray) -> np.ndarray:
    """A number below _GRAMS for each three bytes in a row; different trigrams can share it."""
    wide = buf.astype(np.uint32)
    return ((((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 11)).astype(np.int16)


def _votes(n: int, chance: float) -> int:
    """How many of n places agree with a chance of RECALL, each with a chance of its own."""
    below, votes = 0.0, 0
    while votes < min(n, MOST_VOTES):
        below += math.comb(n, votes) * chance**votes * (1 - chance) ** (n - votes)
        if below > 1 - RECALL:
            break
        votes += 1
    return max(1, votes)


class Walks:
    """One family over the items: for each repeat the sorted hashes of all places, and the item and offset of each."""

    def __init__(self, family: Family, texts: list[bytes], items: list[int]):
        self.family, self.tables = family, []
        reach = family.steps
        joined = np.frombuffer(b"".join(b" " + texts[k] + b" " * (reach + 1) for k in items), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(texts[k]) + reach + 2 for k in items])])
        at = places(joined)
        which = np.searchsorted(starts, at, "right") - 1
        offsets, sizes = at - starts[which] - 1, np.diff(starts) - reach - 2
        # half of the steps are moves: a place so near the end that its walk leaves the item is of no use
        fits = (offsets + family.steps // 2 <= sizes[which]) | (offsets == 0)
        at, which, offsets = at[fits], which[fits], offsets[fits]
        self.n_places = np.bincount(which, minlength=len(items))
        for bits, sampled in family.walks():
            _, h, way = signatures(joined, at, bits, sampled)
            order = np.argsort(h, kind="stable")
            self.tables.append((bits, sampled, [_bitmap(w) for w in way], _bitmap(h), h[order], np.array(items)[which][order], offsets[order]))

    def hits(self, buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each repeat: (places, lo, hi) into its table, with the table's items and offsets."""
        for bits, sampled, filters, last, hashes, items, offsets in self.tables:
            rows, h, _ = signatures(buf, at, bits, sampled, filters)
            go = np.flatnonzero(np.take(last, h >> np.uint32(32 - _FILTER_BITS)))
            lo, hi = np.searchsorted(hashes, h[go], "left"), np.searchsorted(hashes, h[go], "right")
            some = hi > lo
            yield at[rows[go][some]], lo[some], hi[some], items, offsets


class Index:
    """The walks of some items; items are (id, text)."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        buf, ends = folded([t for _, t in items], 1)
        raw = buf.tobytes()
        self.texts = [raw[a:b].strip() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int((1 - SIMILARITY) * len(t) + 1e-9) for t in self.texts], np.int64)
        self.masks = []
        for t in self.texts:
            mask: dict[int, int] = {}
            for k, c in enumerate(t):
                mask[c] = mask.get(c, 0) | 1 << k
            self.masks.append(mask)
        self.grams = [np.bincount(_trigrams(np.frombuffer(t, np.uint8)), minlength=_GRAMS) if len(t) > 64 else None for t in self.texts]
        self.votes = np.ones(len(items), np.int64)
        self.walks = []
        for short, family in FAMILIES.items():
            own = [k for k, t in enumerate(self.texts) if t and (len(t) < SHORT) == short]
            if own:
                walks = Walks(family, self.texts, own)
                self.walks.append(walks)
                if not short:
                    self.votes[own] = [_votes(n, family.chance) for n in walks.n_places.tolist()]
        self.reach = max([w.family.steps for w in self.walks], default=0)

    def windows(self, buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows (text, item, first start, last start) of stretches of windows with enough votes; starts can lie off the text."""
        at = places(buf)
        padded = np.concatenate([buf, np.full(self.reach + 1, 32, np.uint8)])
        found = [np.empty((0, 4), np.int64)]
        for walks in self.walks:
            every = list(walks.hits(padded, at))
            total = sum(int((hi - lo).sum()) for _, lo, hi, _, _ in every)
            parts = max(1, math.ceil(total / MOST_HITS))
            cuts = np.linspace(0, len(self.texts), parts + 1).astype(np.int64)
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                found.append(self._stretches(every, ends, int(first), int(last)))
        return np.concatenate(found)

    def _stretches(self, every: list, ends: np.ndarray, first: int, last: int) -> np.ndarray:
        keys, bias = [], int(self.sizes.max(initial=0))
        span = int(ends[-1]) + 2 * bias + 1
        for at, lo, hi, items, offsets in every:
            for a in range(0, len(at), LANES):
                n = hi[a : a + LANES] - lo[a : a + LANES]
                row = np.repeat(np.arange(len(n)), n)
                entry = np.repeat(lo[a : a + LANES] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(row))
                inside = (items[entry] >= first) & (items[entry] < last)
                row, entry = row[inside], entry[inside]
                where = at[a : a + LANES][row]
                text = np.searchsorted(ends, where, "right") - 1
                # one number for text, item and start, and the place: equal votes of several repeats count once
                keys.append(np.stack([(text * len(self.texts) + items[entry]) * span + where - offsets[entry] + bias, where]))
        hits = np.concatenate(keys, 1) if keys else np.empty((2, 0), np.int64)
        if not hits.shape[1]:
            return np.empty((0, 4), np.int64)
        order = np.lexsort(hits[::-1])
        hits = hits[:, order]
        hits = hits[0, np.concatenate([[True], (hits[:, 1:] != hits[:, :-1]).any(0)])]
        pair, start = hits // span, hits % span - bias
        item = pair % len(self.texts)
        # two places of one match differ in their starts by its insertions and deletions, at most the limit
        upto = np.searchsorted(hits, np.minimum(hits + self.most[item], (pair + 1) * span - 1), "right")
        enough = np.flatnonzero(upto - np.arange(len(hits)) >= self.votes[item])
        if not len(enough):
            return np.empty((0, 4), np.int64)
        stop = start[upto[enough] - 1]
        pair, start, item = pair[enough], start[enough], item[enough]
        new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (start[1:] > np.maximum.accumulate(stop + pair * span)[:-1] - pair[1:] * span)])
        begin = np.flatnonzero(new)
        return np.stack([pair[begin] // len(self.texts), item[begin], start[begin], np.maximum.reduceat(stop, begin)], 1)

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, stop) of the best place of each item in each text, if it is near enough."""
        buf, ends = folded(texts, 1)
        if not len(buf) or not self.walks:
            return []
        raw = buf.tobytes()
        windows = self.windows(buf, ends)
        size, most = self.sizes[windows[:, 1]], self.most[windows[:, 1]]
        lo = np.maximum(ends[windows[:, 0]], windows[:, 2] - most)
        hi = np.minimum(ends[windows[:, 0] + 1], windows[:, 3] + size + 2 * most)
        near = np.ones(len(windows), bool)
        lanes = np.flatnonzero(size <= 64)
        near[lanes] = self._near(windows[lanes, 1], lo[lanes], hi[lanes], buf)
        grams = _trigrams(buf)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in np.flatnonzero(near).tolist():
            doc, item, begin = int(windows[k, 0]), int(windows[k, 1]), int(ends[windows[k, 0]])
            a, n = int(lo[k]), int(size[k])
            if best.get((doc, item), (1,))[0] == 0:
                continue
            # an edit takes three trigrams at most
            if n > 64 and np.minimum(self.grams[item], np.bincount(grams[a : int(hi[k])], minlength=_GRAMS)).sum() < n - 2 - 3 * int(most[k]):
                continue
            if (place := raw.find(self.texts[item], a, int(hi[k]))) >= 0:
                best[doc, item] = (0, place - begin, place + n - begin)
                continue
            distance, stop = infix(self.masks[item], n, raw[a : int(hi[k])])
            if distance <= int(most[k]) and distance < best.get((doc, item), (n + 1,))[0]:
                best[doc, item] = (distance, max(0, a + stop - n - begin), a + stop - begin)
        return [(d, i, *v) for (d, i), v in best.items()]

    def _near(self, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, buf: np.ndarray) -> np.ndarray:
        """Whether a substring of buf[lo:hi] is within the limit of an item of at most 64 bytes: Myers' algorithm over all stretches at once."""
        out = np.zeros(len(item), bool)
        order = np.argsort(hi - lo, kind="stable")
        one = np.uint64(1)
        for a in range(0, len(order), LANES):
            own = order[a : a + LANES]
            used, row = np.unique(item[own], return_inverse=True)
            masks = np.zeros((len(used), 256), np.uint64)
            for k, i in enumerate(used.tolist()):
                for c, mask in self.masks[i].items():
                    masks[k, c] = mask
            masks, row = masks.ravel(), row * 256
            score, most, top = self.sizes[item[own]].copy(), self.most[item[own]], (self.sizes[item[own]] - 1).astype(np.uint64)
            at, end, ok = lo[own].copy(), hi[own], score <= self.most[item[own]]
            vp, vn = np.full(len(own), 2**64 - 1, np.uint64), np.zeros(len(own), np.uint64)
            for _ in range(int((end - at).max(initial=0))):
                inside = at < end
                x = masks[row + buf[np.minimum(at, len(buf) - 1)]] | vn
                d0 = (((x & vp) + vp) ^ vp) | x
                hp = vn | ~(d0 | vp)
                hn = d0 & vp
                score += ((hp >> top) & one).astype(np.int64)
                score -= ((hn >> top) & one).astype(np.int64)
                ok |= inside & (score <= most)
                hp <<= one
                vn = hp & d0
                vp = (hn << one) | ~(hp | d0)
                at += 1
            out[own] = ok
        return out


def infix(mask: dict[int, int], size: int, text: bytes) -> tuple[int, int]:
    """The least edit distance of a pattern to any substring of text, and where the first such substring ends."""
    top, full = 1 << (size - 1), (1 << size) - 1
    vp, vn, score, best, where = full, 0, size, size, 0
    get = mask.get
    for j, c in enumerate(text):
        x = get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hp = vn | ~(d0 | vp) & full
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best, where = score, j + 1
        hp = hp << 1
        vn = hp & d0 & full
        vp = (hn << 1 | ~(hp | d0)) & full
    return best, where

def _chunks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items in chunks of about CHUNK_BYTES, and whether there are several; items without a word match nothing."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == k).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"]) for r in part.collect()], chunks > 1


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, similarity, start, stop): the items that a document holds, each once per row of docs.

    start and stop are bytes of the folded text, the start as estimated from the stop. Null and empty texts
    and items match nothing; items that share an id count as variants of one and can each give a row; repeated rows of
    docs give repeated rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items, several in _chunks(benchmark):
        held = spark.sparkContext.broadcast(Index(items))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                ids = b.column(0).to_pylist()
                for first, texts in slices(b.column(1).to_pylist()):
                    rows = [(ids[first + d], index.ids[i], dist, 1 - dist / len(index.texts[i]), a, z) for d, i, dist, a, z in index.leaks(texts)]
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "item_id", "distance", "similarity", "start", "stop"])

        part = docs.mapInArrow(run, _LEAK)
        if several:  # one chunk at a time is held
            part = written(part, "leaks")
            held.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item; all rows of such an id go, a null id like any other."""
    found = written(find_leaks(docs, benchmark).select(id_key().alias("_leak")).distinct(), "leaks")
    if found.count() <= BROADCAST_ROWS:  # 8 bytes each; beyond that, both sides are shuffled
        found = F.broadcast(found)
    keyed = docs.select(F.struct("*").alias("row"), id_key().alias("_id"))
    return keyed.join(found, F.col("_id") == F.col("_leak"), "left_anti").select("row.*")

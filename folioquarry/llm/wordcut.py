"""Whole texts encoded by segments: cuts at which byte-level tokenizers always cut too, each segment encoded once.

A segment is a run of blanks and line feeds with the run of other characters after it. In texts of plain letters, digits
and punctuation, letters and punctuation are cut apart as well; texts with other white space are encoded as a whole. A
batch is cut, hashed (64 bits, by tabulation) and put together in numpy; only segments that a bounded memo of hashes does
not know reach the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd

from folioquarry.llm.hashtable import HashTable

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation without the apostrophe, which can belong to a contraction
#: White space other than blanks and line feeds.
_ODD_SPACE = re.compile(r"[^\S \n]")
_SPACE, _MARK, _WORD, _ODD = 0, 1, 2, 3
_LONGEST = 64

_KIND = np.full(256, _ODD, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = _WORD if chr(_c).isalnum() else _MARK
_KIND[[32, 10]] = _SPACE
_KIND[39] = _ODD
_KIND[0xC3] = _WORD
_KIND[0x80:0xC0] = _WORD  # after 0xC3; other lead bytes are odd
_TABLE = np.random.default_rng(64).integers(0, 2**64, _LONGEST * 256, np.uint64)


class SegmentEncoder:
    """encode(segments) -> (the ids of all in a row, how many of each); whole(text) -> bytes; width: bytes of an id.

    Texts that hold one of the `special` strings are encoded as a whole, as such a string can span segments.
    Without `whole`, cuts are made before runs of blanks and line feeds only, in every text. The memo holds about
    0.6 * 2**bits segments and their ids, and starts anew when it is full.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], bytes] | None, width: int, bits: int = 19, special: list[str] | None = None):
        self.encode, self.whole, self.width, self.special = encode, whole, width, special or []
        self.memo, self.pool, self.used = HashTable(bits), np.empty(1 << 16, f"<u{width}"), 0

    def payloads(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as arrays of unsigned integers."""
        kind = f"<u{self.width}"
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        joined = b"".join(raws)
        buf = np.frombuffer(joined, np.uint8)
        out: list[np.ndarray | None] = [None] * len(texts)
        if not len(buf):
            return [np.empty(0, kind) for _ in texts]
        kinds = _KIND[buf]
        if self.whole is None:
            kinds[kinds != _SPACE] = _WORD
        odd = kinds == _ODD
        odd[1:] |= (buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)) & (self.whole is not None)
        sums = np.concatenate([[0], np.cumsum(odd, dtype=np.int64)])
        odd_texts = np.flatnonzero(sums[at[1:]] > sums[at[:-1]])
        for k in odd_texts.tolist():
            if _ODD_SPACE.search(texts[k]):
                out[k] = np.frombuffer(self.whole(texts[k]), kind)
            own = kinds[at[k] : at[k + 1]]
            own[own != _SPACE] = _WORD
        for word in self.special:
            if word.encode() in joined:
                for k in [k for k, t in enumerate(texts) if word in t]:
                    out[k] = np.frombuffer(self.whole(texts[k]), kind)
        begins = np.empty(len(buf), bool)
        begins[0] = True
        begins[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE)
        begins[at[:-1][at[:-1] < len(buf)]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(buf))
        place = np.arange(len(buf), dtype=np.int64) - np.repeat(starts, sizes)
        np.minimum(place, _LONGEST - 1, out=place)
        place <<= 8
        place |= buf
        h = np.add.reduceat(_TABLE[place], starts)
        long = np.flatnonzero(sizes > _LONGEST)
        codes, uniques = pd.factorize(h)
        first = np.empty(len(uniques), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        skip = np.zeros(len(uniques), bool)
        skip[codes[long]] = True
        pool, lens = self._known(uniques, first, starts, sizes, joined, skip)
        if len(long):  # beyond the table: each on its own
            codes[long] = len(uniques) + np.arange(len(long))
            more, n = self._encoded(starts[long], sizes[long], joined)
            pool, lens = np.concatenate([pool, more]), np.concatenate([lens, n])
        offs = np.cumsum(lens) - lens
        each = lens[codes]
        ends = np.cumsum(each)
        ids = pool[np.repeat(offs[codes] - (ends - each), each) + np.arange(ends[-1])]
        cut = np.concatenate([[0], ends])[np.searchsorted(starts, at)]
        return [ids[cut[k] : cut[k + 1]] if out[k] is None else out[k] for k in range(len(texts))]

    def _encoded(self, starts: np.ndarray, sizes: np.ndarray, joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        flat, lens = self.encode([joined[a : a + n].decode("utf-8", "surrogatepass") for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        return flat.astype(f"<u{self.width}"), lens

    def _known(self, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, sizes: np.ndarray, joined: bytes, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all segments in a row, and how many each has; those to skip (known by their first bytes only) have none."""
        found = self.memo.find(hashes)
        missing = np.flatnonzero((found < 0) & ~skip)
        known = np.flatnonzero((found >= 0) & ~skip)
        lens, source = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        lens[known], source[known] = found[known] & 0xFFFF, found[known] >> 16
        flat, n = self._encoded(starts[first[missing]], sizes[first[missing]], joined)
        lens[missing] = n
        into = np.cumsum(lens) - lens
        out = np.empty(int(lens.sum()), flat.dtype)
        out[_runs(into[known], lens[known])] = self.pool[_runs(source[known], lens[known])]
        out[_runs(into[missing], n)] = flat
        self._remember(hashes[missing], flat, n)
        return out, lens

    def _remember(self, hashes: np.ndarray, flat: np.ndarray, n: np.ndarray) -> None:
        if self.memo.n + len(hashes) > self.memo.most:
            self.memo.clear()
            self.used = 0
        if len(hashes) > self.memo.most:
            return
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(flat), self.used), self.pool.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.memo.add(hashes, (self.used + np.cumsum(n) - n) << 16 | n)
        self.used += len(flat)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)

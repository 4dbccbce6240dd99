"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is read here (no library) and compiled to three machines:

* the normaliser: blanks become U+2581, one more of them is put in front of a text;
* the pieces: a trie whose states and arcs stand in flat arrays (an arc for each state and character that follows); a
  path from the root to a final state reads a piece, emits its id and weighs its negated score. For a character that no piece
  is, a fallback arc emits its byte pieces (or the unknown piece) at a weight above all others;
* for merge-based models, an acceptor of pairs of adjacent pieces. Merging by rank is a local law: a sequence of pieces is
  what the merges make of a text if and only if, for each two neighbours a and b, merging the string ab gives (a, b) again.
  Other pairs weigh infinity. So composition leaves one path of finite weight to each place of the text, and the
  tropical-semiring shortest path is the very encoding that the model's merges define. For unigram models no pair is ruled out.

The shortest path relaxes the arcs of the composed lattice from left to right, for all segments at once: each
place has the weight of the lightest path to it and the piece that it ends with. No piece spans a character before U+2581 or
a line feed, so texts are cut there and each segment is composed once (see wordcut.py); segments of more than WIDEST
characters are relaxed one by one.

Decoding maps ids to pieces, bytes to characters, U+2581 to blanks, and takes the first blank off. Every text without
U+2581 of its own comes back exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.fold import slices
from folioquarry.llm.hashtable import HashTable
from folioquarry.llm.wordcut import SegmentEncoder

# Fixed values of the public model format: kinds of pieces and of models.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
_SPACE = "▁"
_UNKNOWN_COST = 10.0
#: Places (as a power of two) for the verdicts on pairs that a worker keeps.
PAIR_BITS = 20
#: Longer segments are relaxed one by one.
WIDEST = 40
_CODE_BITS = 21


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            c = raw[at]
            at += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while at < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, raw[at : at + n]
            at += n


class Machine:
    """The compiled model. encode_segment() and decode() work on one string or one list of ids."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.costs: list[float] = []
        self.kinds: list[int] = []
        model, normaliser = _UNIGRAM, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.costs.append(-struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                normaliser = dict(_fields(value))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or model not in (_UNIGRAM, _BPE):
            raise ValueError("only models with the identity normaliser that keep white space, of unigram or merge kind, are compiled")
        self.merges = model == _BPE
        self.prefix = " " if normaliser.get(3, 1) else ""
        self.id_of = {p: k for k, p in enumerate(self.pieces) if self.kinds[k] in (_NORMAL, _USER)}
        if any(_SPACE in p.lstrip(_SPACE) or "\n" in p for p in self.id_of):
            raise ValueError("a piece spans words")
        self.byte_ids = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.kinds[k] == _BYTE}
        self.unknown = next((k for k, kind in enumerate(self.kinds) if kind == _UNKNOWN), 0)
        self.longest = max(map(len, self.id_of), default=1)
        self.fallback_cost = max([c for c, k in zip(self.costs, self.kinds, strict=True) if k == _NORMAL], default=0.0) + _UNKNOWN_COST
        self._compile()
        self.verdicts = HashTable(PAIR_BITS)
        self.text_of = [p.replace(_SPACE, " ").encode() if k in (_NORMAL, _USER, _UNUSED) else bytes([int(p[3:5], 16)]) if k == _BYTE else b" \xe2\x81\x87 " if k == _UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _compile(self) -> None:
        """The trie of the pieces: arcs (state, character) -> state in one table; the piece that ends in a state, or -1."""
        arcs: dict[int, int] = {}
        final = [-1]
        for piece, k in self.id_of.items():
            state = 0
            for c in piece:
                key = state << _CODE_BITS | ord(c)
                state = arcs.get(key, 0)
                if not state:
                    state = arcs[key] = len(final)
                    final.append(-1)
            final[state] = k
        self.arcs = HashTable(max(4, int(len(arcs) / 0.5).bit_length()))
        self.arcs.add(np.array(list(arcs), np.uint64), np.array(list(arcs.values()), np.int64))
        self.final = np.array(final, np.int64)
        self.weight = np.array(self.costs, np.float64)
        self.fallback_at = len(self.pieces)  # fallback arcs emit this plus the character

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short string: always the best-ranked pair, the first of equal ones."""
        parts = list(text)
        ids, costs = self.id_of, self.costs
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or costs[i] < best):
                    best, at = costs[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may stand after piece a ("" at the start)."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def _string(self, k: int) -> str:
        return "" if k < 0 else self.pieces[k] if k < self.fallback_at else chr(k - self.fallback_at)

    def _allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The acceptor's verdicts on pairs, kept in a table; what is not there is worked out."""
        keys = ((before + 1) << (_CODE_BITS + 1) | piece).astype(np.uint64)
        out = self.verdicts.find(keys)
        new = np.flatnonzero(out < 0)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            mask = (1 << (_CODE_BITS + 1)) - 1
            ok = np.array([self.follows(self._string((k >> (_CODE_BITS + 1)) - 1), self._string(k & mask)) for k in fresh.tolist()], np.int64)
            out[new] = ok[back]
            self.verdicts.add(fresh, ok)
        return out > 0

    def _relax(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of characters, longest first: the piece that the lightest path to each place ends with, and its length."""
        rows, n = codes.shape
        cost = np.full((rows, n + 1), np.inf)
        cost[:, 0] = 0.0
        last = np.full((rows, n + 1), -1, np.int64)
        size = np.zeros((rows, n + 1), np.int32)
        reach = np.searchsorted(-sizes, -np.arange(n + 1), "right")  # so many rows have a place k
        for start in range(n):
            own, state = np.arange(reach[start + 1]), np.zeros(reach[start + 1], np.int64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                if own[-1] >= reach[end]:
                    stays = int(np.searchsorted(own, reach[end]))
                    own, state = own[:stays], state[:stays]
                    if not stays:
                        break
                code = codes[own, end - 1]
                onward = self.arcs.find((state << _CODE_BITS | code).astype(np.uint64))
                piece = self.final[onward]  # no arc: the last state's, seen to below
                found = onward >= 0
                if end == start + 1:
                    fallback = ~found | (piece < 0)
                    piece = np.where(fallback, self.fallback_at + code, piece)
                    weight = np.where(fallback, self.fallback_cost, self.weight[np.where(fallback, 0, piece)])
                    who = own
                else:
                    ends = np.flatnonzero(found & (piece >= 0))
                    piece = piece[ends]
                    weight, who = self.weight[piece], own[ends]
                if len(who):
                    total = cost[who, start] + weight
                    if self.merges:
                        total[~self._allowed(last[who, start], piece)] = np.inf
                    better = total < cost[who, end]
                    who = who[better]
                    cost[who, end], last[who, end], size[who, end] = total[better], piece[better], end - start
                own, state = own[found], onward[found]
                if not len(own):
                    break
        return last, size

    def _emitted(self, piece: int) -> list[int]:
        if piece < self.fallback_at:
            return [piece]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[c] for c in chr(piece - self.fallback_at).encode("utf-8", "surrogatepass")]

    def encode_segments(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each segment, by shortest paths."""
        out: list[np.ndarray | None] = [None] * len(texts)
        wide = [k for k, t in enumerate(texts) if 0 < len(t) <= WIDEST]
        for k in {*range(len(texts))} - {*wide}:
            out[k] = np.array(self.encode_segment(texts[k]), np.int64)
        wide.sort(key=lambda k: -len(texts[k]))
        for first in range(0, len(wide), 1 << 13):
            own = wide[first : first + (1 << 13)]
            sizes = np.array([len(texts[k]) for k in own])
            flat = np.frombuffer("".join([texts[k] for k in own]).replace(" ", _SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
            codes = np.zeros((len(own), int(sizes[0])), np.int64)
            codes[np.arange(codes.shape[1]) < sizes[:, None]] = flat
            last, size = self._relax(codes, sizes)
            place, row, columns = sizes.copy(), np.arange(len(own)), []
            while place.any():
                columns.append(np.where(place > 0, last[row, place], -1))
                place = place - size[row, place]
            path = np.stack(columns[::-1], 1)
            falls = (path >= self.fallback_at).any(1)
            flat, counts = path[path >= 0], (path >= 0).sum(1)
            ends = np.cumsum(counts)
            for j, (k, a, z) in enumerate(zip(own, (ends - counts).tolist(), ends.tolist(), strict=True)):
                out[k] = flat[a:z] if not falls[j] else np.array([i for p in flat[a:z].tolist() for i in self._emitted(p)], np.int64)
        return out

    def shortest_path(self, text: str) -> list[int]:
        """The pieces of the lightest path through the lattice of one normalised string, as _relax() gives them."""
        n, ids, longest = len(text), self.id_of, self.longest
        cost, last, size = [0.0] + [float("inf")] * n, [-1] * (n + 1), [0] * (n + 1)
        verdict: dict[tuple[int, int], bool] = {}
        for start in range(n):
            for end in range(start + 1, min(n, start + longest) + 1):
                piece = ids.get(text[start:end])
                if piece is None:
                    if end > start + 1:
                        continue
                    piece, weight = self.fallback_at + ord(text[start]), self.fallback_cost
                else:
                    weight = self.costs[piece]
                if cost[start] + weight < cost[end]:
                    if self.merges:
                        pair = (last[start], piece)
                        if pair not in verdict:
                            verdict[pair] = self.follows(self._string(pair[0]), self._string(piece))
                        if not verdict[pair]:
                            continue
                    cost[end], last[end], size[end] = cost[start] + weight, piece, end - start
        path, at = [], n
        while at:
            path.append(last[at])
            at -= size[at]
        return path[::-1]

    def encode_segment(self, text: str) -> list[int]:
        return [i for p in self.shortest_path(text.replace(" ", _SPACE)) for i in self._emitted(p)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def _coder(path: str) -> tuple[Machine, SegmentEncoder]:
    with open(path, "rb") as f:
        machine = Machine(f.read())
    width = 2 if len(machine.pieces) <= 1 << 16 else 4

    def many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = machine.encode_segments(words)
        return np.concatenate([np.empty(0, np.int64), *out]), np.array([len(x) for x in out], np.int64)

    return machine, SegmentEncoder(many, None, width)


def encode_texts(texts: list[str | None], model: str) -> list[np.ndarray]:
    """The ids of each whole text; none for a null or empty one."""
    machine, coder = _coder(model)
    return coder.payloads([machine.prefix + t if t else "" for t in texts])


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>) of every row; null and empty texts have no ids. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for _, texts in slices(b.column(1).to_pylist()):
                ids = encode_texts(texts, model)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists], names=["doc_id", "ids"])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = _coder(model)
        for b in batches:
            texts = [None if ids is None else machine.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), n_bytes (byte pieces),
    round_trip (whether decoding gives the text back; null and empty texts: true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = _coder(model)
        is_byte = np.array([k == _BYTE for k in machine.kinds])
        for b in batches:
            out: list[list] = [[], [], [], []]
            for _, texts in slices(b.column(1).to_pylist()):
                for text, ids in zip(texts, encode_texts(texts, model), strict=True):
                    out[0].append(len(ids))
                    out[1].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    out[2].append(int(np.count_nonzero(is_byte[ids])))
                    out[3].append(machine.decode(ids.tolist()) == (text or ""))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean")

"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is: data frames (each a run of whole documents, ids as little-endian unsigned integers of 2 or 4 bytes, as the
vocabulary needs); one skippable frame with the document index (that width; id and number of ids of each document;
zstandard-compressed); one skippable frame with the seek table in the public seekable layout (compressed size, size and the
low half of XXH64 of each frame before it, then frame count, flags and the magic number 0x8F92EAB1). The index is the last
frame in the table, of size 0, as skippable frames are; other readers of that layout pass over it. A reader loads the tail,
finds the frames of the documents asked for, and decompresses only those.

Texts are range-partitioned by id (and the hash of the text, so that rows of one id spread) and encoded on the way into the
files, so each is shuffled once and encoded once. A file ends at FILE_BYTES or FILE_DOCS and the task goes on in another, so
an index stays small whatever the number of tasks. Files get names of their own for each attempt of a task, and only those
reported by the attempt that won are listed and read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm.common import NULL_ID, fresh_path, id_key
from folioquarry.llm.fold import slices
from folioquarry.llm.wordcut import LETTERS, MARKS, SegmentEncoder

END_ID = 0
FRAME_BYTES = 1 << 18
FILE_BYTES, FILE_DOCS = 512 << 20, 1_000_000
LEVEL = 3
_SKIP_INDEX, _SKIP_SEEK, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_MANIFEST = "part int, path string, docs long, ids long, nth int"


class Writer:
    """Writes documents in the order given; payloads are arrays of ids, stored in `width` bytes each."""

    def __init__(self, sink, width: int = 4, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        payload = ids.astype(f"<u{self.width}").tobytes()
        self.pending.append(payload)
        self.size += len(payload)
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.pack.compress(raw)
            self.sink.write(packed)
            self.written += len(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = self.pack.compress(np.array([self.width], "<i8").tobytes() + np.array(self.ids, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self.sink.write(struct.pack("<II", _SKIP_INDEX, len(index)) + index)
        self.frames.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, _SEEK_MAGIC)
        self.sink.write(struct.pack("<II", _SKIP_SEEK, len(table)) + table)


class Reader:
    """Random access to the documents of a file; source is a seekable binary file."""

    def __init__(self, source):
        self.source = source
        source.seek(0, os.SEEK_END)
        end = source.tell()
        source.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEK_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        source.seek(end - 9 - 12 * count - 8)
        head = struct.unpack("<II", source.read(8))
        if head != (_SKIP_SEEK, 12 * count + 9) or not count:
            raise ValueError("no seek table where it belongs")
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.frames, index_len = table[:-1], int(table[-1, 0]) - 8
        source.seek(end - 9 - 12 * count - 8 - index_len)
        raw = zstandard.ZstdDecompressor().decompress(source.read(index_len))
        n = len(raw) // 16
        self.width = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids = np.frombuffer(raw, "<i8", n, 8)
        self.lengths = np.frombuffer(raw, "<u8", n, 8 + 8 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frame_at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.frame_ids = np.concatenate([[0], np.cumsum(self.frames[:, 1] // self.width)])
        self.unpack = zstandard.ZstdDecompressor()
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            self.source.seek(int(self.frame_at[k]))
            raw = self.unpack.decompress(self.source.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, raw)
        return self.held[1]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, as unsigned 32-bit integers; a document never crosses frames."""
        f = int(np.searchsorted(self.frame_ids, self.starts[k], "right")) - 1
        at = int(self.starts[k] - self.frame_ids[f]) * self.width
        return np.frombuffer(self.frame(f), f"<u{self.width}", int(self.lengths[k]), at).astype("<u4")

    def find(self, doc_id: int) -> list[int]:
        lo, hi = np.searchsorted(self.ids, [doc_id, doc_id + 1])
        return list(range(int(lo), int(hi)))


#: A segment whose pre-tokens are plain to see: a line feed or none, then letters or punctuation with a blank or none.
_PLAIN = re.compile(rf"(\n?)( ?(?:[{LETTERS}]+|[{MARKS}]+))")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


@cache
def _encoder(path: str):
    """An encoder of whole texts by segments.

    The library's model is asked directly for segments whose pre-tokens are plain to see, else the whole library.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_file(path)
    width = 2 if made.get_vocab_size() <= 1 << 16 else 4
    code, letters, model = {2: "H", 4: "I"}[width], _byte_letters(), made.model.tokenize
    plain, blank, line_feed = _PLAIN.fullmatch, chr(letters[32]), array(code, [t.id for t in model(chr(letters[10]))]).tobytes()

    def whole(text: str) -> bytes:
        return array(code, made.encode(text, add_special_tokens=False).ids).tobytes()

    def many(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for w in words:
            if not plain(w):
                out.append(whole(w))
                continue
            head, lead = b"", w[0]
            if lead == "\n":
                head, w = line_feed, w[1:]
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(letters)
            elif w[0] == " ":
                w = blank + w[1:]
            out.append(head + array(code, [t.id for t in model(w)]).tobytes())
        return np.frombuffer(b"".join(out), f"<u{width}"), np.array([len(x) for x in out], np.int64) // width

    return SegmentEncoder(many, whole, width, special=[t.content for t in made.get_added_tokens_decoder().values()])


def write(docs: DataFrame, tokenizer: str, path: str) -> list[tuple[int, str, int, int]]:
    """Encodes every whole text (null: empty), appends the end id, and writes files of ascending ids below path.

    Returns (part, file, documents, ids) in order: one row a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        attempt, writer, names = uuid.uuid4().hex, None, []

        def closed() -> pa.RecordBatch:
            writer.close()
            writer.sink.close()
            row = (part, names[-1], len(writer.ids), sum(writer.lengths), len(names))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["part", "path", "docs", "ids", "nth"])

        for b in batches:
            ids = b.column(0).to_pylist()
            for first, texts in slices(b.column(1).to_pylist()):
                encoder = _encoder(tokenizer)
                for i, own in zip(ids[first:], encoder.payloads([t or "" for t in texts]), strict=False):
                    if writer is None:
                        names.append(f"{root}/part-{part:06d}-{len(names):04d}-{attempt}.tokz")
                        writer = Writer(fs.open_output_stream(names[-1]), encoder.width)
                    writer.add(i, np.append(own, own.dtype.type(END_ID)))
                    if writer.written >= FILE_BYTES or len(writer.ids) >= FILE_DOCS:
                        yield closed()
                        writer = None
        if writer:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(id_key().alias("id"), "text", F.xxhash64("text").alias("own"))
    ordered = keyed.repartitionByRange(n, "id", "own").sortWithinPartitions("id", "own", "text").select("id", "text")
    found = ordered.mapInArrow(run, _MANIFEST).collect()  # a row a file
    return [tuple(r)[:4] for r in sorted(found, key=lambda r: (r["part"], r["nth"]))]


def read(spark, manifest: list[tuple[int, str, int, int]], path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    files, start = [], 0
    for _, name, _, ids in manifest:
        files.append((name, start))
        start += ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(path)
        for b in batches:
            for k in b.column(0).to_pylist():
                name, base = files[k]
                with fs.open_input_file(name) as source:
                    reader = Reader(source)
                    for a in range(0, len(reader.ids), 1000):
                        z = min(a + 1000, len(reader.ids))
                        payloads = [reader.document(j) for j in range(a, z)]
                        ids = reader.ids[a:z]
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NULL_ID), pa.array(reader.starts[a:z] + base), pa.array(reader.lengths[a:z]), pa.array([zlib.crc32(p.tobytes()) for p in payloads], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, len(files))
    each = spark.range(0, len(files), 1, n)
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Repeated ids lie side by side (equal ones in the order of the hashes of their texts); null ids come first; an empty table
    gives an empty result; other columns are not read.
    """
    path = fresh_path(docs.sparkSession, "token-files")
    return read(docs.sparkSession, write(docs, tokenizer, path), path)

"""Texts folded to words for comparison, whole batches at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_FOLD = np.full(256, 32, np.uint8)
for _c in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _FOLD[_c] = _c
for _c in range(65, 91):
    _FOLD[_c] = _c + 32


def folded(texts: list[str | None], tail: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the start of each text plus the end of the last.

    Letters of ASCII and Latin-1 are lower case, runs of other ASCII characters are one blank; every text begins with a
    blank and ends with `tail` blanks.
    """
    raws = [b"".join((b" ", (t or "").encode("utf-8", "surrogatepass"))) for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    buf = _FOLD[raw]
    upper = np.flatnonzero(raw[:-1] == 0xC3) + 1
    upper = upper[(raw[upper] >= 0x80) & (raw[upper] <= 0x9E) & (raw[upper] != 0x97)]
    buf[upper] += 32
    at = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.empty(len(buf), bool)
    keep[:1] = True
    keep[1:] = (buf[1:] != 32) | (buf[:-1] != 32)
    keep[at[:-1]] = True
    counts = np.add.reduceat(keep, at[:-1], dtype=np.int64) if len(raws) else np.empty(0, np.int64)
    buf = buf[keep]
    ends = np.concatenate([[0], np.cumsum(counts)])
    if tail:
        buf = np.insert(buf, np.repeat(ends[1:], tail), 32)
        ends = ends + tail * np.arange(len(ends))
    return buf, ends


def slices(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, list[str | None]]]:
    """The texts in runs of about `most` characters, each with the number of its first text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, texts[at : k + 1]
            at, size = k + 1, 0
    if at < len(texts):
        yield at, texts[at:]

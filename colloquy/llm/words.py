"""Words, polynomial hashes and batches of documents as NumPy arrays, for use inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are Rabin-Karp polynomials modulo 2**64 with odd bases,
so every substring hash comes from two running sums and a modular inverse; a bit mixer follows.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation, for operators whose words are runs of letters and digits.
BREAK = SPACE.copy()
BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
CHUNK = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: What tasks keep for later tasks of the same worker process; stages with no use for it give it back.
CACHES: list[dict] = [_powers]


def shed(*kept: dict) -> None:
    """Give back memory that this worker process holds from earlier tasks: caches but those `kept`, and freed arrays.

    Python workers live on from stage to stage, so a stage with large arrays begins with what all earlier ones kept.
    """
    import pyarrow as pa

    for cache in CACHES:
        if not any(cache is k for k in kept):
            cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of at most about CHUNK bytes that fall on white space."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        while end < len(data) and not SPACE[data[end]]:
            step = SPACE[data[end:end + 4096]]
            end = end + int(step.argmax()) if step.any() else min(end + 4096, len(data))
        yield at, end
        at = end


@dataclass
class Words:
    """Words of some documents: bytes, byte spans, hash and document number of each word; first[d] is the first word of d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every run of `size` words that lies in one document."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        begin = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1:])
        up, down = powers(WORD_BASE, n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=run[1:])
        return begin, mix((run[begin + size] - run[begin]) * down[begin])


def words_of(texts: list[bytes | None], lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words of UTF-8 texts; null counts as empty. `space` tells which bytes part words."""
    blobs = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(blobs), np.uint8)
    if lower:
        data = LOWER[data]
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1
    offset = np.concatenate([[0], np.cumsum(size)])
    starts, ends, hashes = [], [], []
    for lo, hi in _slices(data):
        part = data[lo:hi]
        inside = np.empty(len(part) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(space[part], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        up, down = powers(BYTE_BASE, len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        hashes.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + lo)
        ends.append(e + lo)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    doc = np.searchsorted(offset, start, side="right") - 1
    first = np.searchsorted(start, offset)
    return Words(data, start, join(ends, np.int64), join(hashes, np.uint64), doc, first)


def chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of about `limit` bytes; a longer document is a range of its own."""
    lo = total = 0
    for i, t in enumerate(texts):
        size = len(t or b"")
        if i > lo and total + size > limit:
            yield lo, i
            lo, total = i, 0
        total += size
    if lo < len(texts):
        yield lo, len(texts)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as byte planes of their differences: high planes are zeros, which shuffle compression drops."""
    step = np.diff(values, prepend=np.zeros(1, np.uint64))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    """Byte planes of whole numbers, so that shuffle compression drops the empty ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(blob: bytes, kind: str) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(rows.T).view(kind).ravel()


def sliced(batches, rows: int = 1024) -> Iterator:
    """Arrow batches in slices of so many rows, for tasks that hold Python copies of a batch's texts."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def binary_list(column) -> list[bytes | None]:
    """UTF-8 bytes of an Arrow string column."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()

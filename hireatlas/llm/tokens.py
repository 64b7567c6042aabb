"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow batch.

Used inside Arrow tasks only. A batch of texts becomes one byte array with document offsets; words come out as
start and end offsets with a 64-bit hash each. No text is shortened: a document longer than a chunk is its own chunk. A chunk takes
about 60 bytes a byte while it is worked on; what a batch took goes back to the system, so that idle workers stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: True for the bytes that separate words: `[\x20\x09-\x0D]`.
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: True for every ASCII byte that is no letter and no digit; bytes of other characters belong to words.
NOT_ALNUM = (_BYTES < 48) | ((_BYTES > 57) & (_BYTES < 97)) | ((_BYTES > 122) & (_BYTES < 128))

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, length: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < length:
        factors = np.full(max(length, CHUNK_BYTES + 1), base, np.uint64)
        factors[0] = 1
        table = _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every bit of its input."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents: first and last document, their bytes, and n + 1 offsets into these. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    if len(data) > CHUNK_BYTES:
        give_back()


class Words:
    """The words of a chunk: `start` and `end` byte offsets, `doc` index, and `hash`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True):
        low = LOWER[data] if lower else data
        inside = ~separators[low]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets[:-1]] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        starts = inside & (~before | edge[:-1])
        after = np.zeros(len(data), bool)
        edge[:] = False
        edge[offsets[1:]] = True
        if len(data):
            after[:-1] = inside[1:]
        ends = inside & (~after | edge[1:])
        self.low = low
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # first word of each document, n + 1 of them
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        weights = _TABLE[low] * _power_table("up", _BASE, len(data) + 1)[: len(data)]
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])
        self._down = _power_table("down", _BASE_INVERSE, len(data) + 1)
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes of any spans; equal bytes give equal values wherever they stand."""
        value = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(value ^ (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def crc32_of_ids(ids: pa.Array) -> np.ndarray:
    """crc32 of each id written as text."""
    import zlib

    return np.array([zlib.crc32(str(i).encode()) for i in ids.to_pylist()], np.int64)

"""Text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time, inside a task: whole texts as UTF-8
bytes, word boundaries, and 64-bit hashes of words, computed for the batch as arrays.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: A word is a run of characters other than the ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mod_of_id(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m: the folds that the queries' contracts fix."""
    return F.crc32(doc_id.cast("string")) % F.lit(m)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(off):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Returns what this worker has freed to the machine: a worker that waits for its next task should not hold the last one's arrays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text each, so that a task's arrays stay small; a longer text is a slice alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = string_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
        give_back()


class Words:
    """The words of a batch of texts: byte spans, the text each is in, and where each text's words begin."""

    blank = _BLANK  # which bytes part words

    def __init__(self, texts: pa.Array, fold: bool = True):
        raw, self.offsets = string_bytes(texts)
        self.bytes = _FOLD[raw] if fold else raw
        n = len(raw)
        solid = ~self.blank[raw]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        edge = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        begins[edge] = solid[edge]  # texts lie side by side: a text's edge also parts words
        ends[edge - 1] = solid[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word."""
        up, down = _powers(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[:-1], out=sums[1:])
        return mix64((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].tobytes().decode()

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's k-word windows; a text of fewer words gives one, of all its words."""
        w = self.hashes()
        whole = _windows(w, k) if len(w) >= k else w[:0]
        out = []
        for a, n in zip(self.first.tolist(), self.count.tolist()):
            if n >= k:
                out.append(np.unique(whole[a : a + n - k + 1]))
            elif n:
                out.append(_windows(w[a : a + n], n))
            else:
                out.append(w[:0])
        return out


def _windows(w: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * _BASE + w[i : i + len(h)]
        h ^= h >> np.uint64(29)
    return mix64(h)

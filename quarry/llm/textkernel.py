"""Arrow/numpy kernels over the UTF-8 bytes of whole Arrow batches of texts.

All functions work on a chunk: the bytes of consecutive texts laid end to end
(``buf``, with 8 bytes of padding) and ``offsets`` (one more than texts). Null
texts count as empty. Nothing here loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PAD = 8
#: Bytes of a chunk whose arrays stay in the processor's cache, and of one whose distinct pieces are worth gathering.
CHUNK_BYTES, BATCH_BYTES = 256 << 10, 4 << 20

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true for the bytes in the inclusive spans."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return table


#: The separators of words: space and U+0009 to U+000D.
WORD_SEPARATORS = byte_set((0x20, 0x20), (0x09, 0x0D))


@dataclass
class Chunk:
    """Consecutive rows ``lo`` to ``hi`` of a batch, and the bytes of their texts."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> str:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """Cut a string array into chunks of at most ``limit`` bytes (or one text)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        a, b = int(offsets[lo]), int(offsets[hi])
        buf = np.zeros(b - a + PAD, dtype=np.uint8)
        buf[: b - a] = _LOWER[raw[a:b]] if lower else raw[a:b]
        yield Chunk(lo, hi, buf, offsets[lo : hi + 1] - a)
        lo = hi


def words(chunk: Chunk, separators: np.ndarray = WORD_SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of all words, and for each text the place of its first (one more at the end)."""
    n = len(chunk.buf) - PAD
    inside = ~separators[chunk.buf[:n]]
    edge = np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return starts, lengths, np.searchsorted(starts, chunk.offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche, in place."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def span_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, read eight bytes at a time by unaligned gathers."""
    view = np.ndarray(shape=(max(len(buf) - 7, 0),), dtype="<u8", buffer=buf, strides=(1,))
    h = lengths.astype(U64) * U64(0x9E3779B97F4A7C15)
    at, left, which = starts, lengths, None
    while len(at):
        part = view[at] & _MASK[np.minimum(left, 8)]
        if which is None:
            h = mix(h ^ part)
        else:
            h[which] = mix(h[which] ^ part)
        more = np.flatnonzero(left > 8)
        which = more if which is None else which[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def shingle_hashes(tokens: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` tokens within texts, repeats included.

    A text with fewer tokens gives its whole sequence as one, one with none gives
    none. Returns the hashes and for each text the place of its first.
    """
    counts = np.diff(bounds)
    n = len(tokens)
    full = np.zeros(n, dtype=U64)
    size = max(n - width + 1, 0)
    if size:
        h = np.full(size, width, dtype=U64)
        for k in range(width):
            h = mix(h * U64(0x9E3779B97F4A7C15) + tokens[k : k + size])
        full[:size] = h
    doc = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(n) + width <= bounds[1:][doc] if n else np.zeros(0, bool)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.array([counts[i]], dtype=U64)
        for k in range(bounds[i], bounds[i + 1]):
            h = mix(h * U64(0x9E3779B97F4A7C15) + tokens[k])
        full[bounds[i]] = h[0]
        keep[bounds[i]] = True
    out = full[keep]
    have = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return out, np.concatenate([[0], np.cumsum(have)])

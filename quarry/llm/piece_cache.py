"""Whole-text encoding with the tokenizers library, each distinct piece of text once.

A text is cut only where the library's splitting pattern always ends a match:
where white space begins after a character that isn't white space, after a
single line break between such characters, and between an ASCII letter and an
ASCII sign other than the apostrophe. Merges never cross matches, so the ids of
the pieces laid end to end are the ids of the text. Pieces are told apart by
64-bit hashes; ids of pieces seen before come from a table in the worker.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pandas as pd

from quarry.llm.textkernel import PAD, Chunk, byte_set, span_hashes

#: Entries at which a worker's table starts anew; only speed depends on it.
TABLE_ENTRIES = 2_000_000
#: Longer pieces go to the library each time.
LONGEST_CACHED = 64

_SPACE = byte_set((0x20, 0x20), (0x0A, 0x0A))
_GRAPHIC = byte_set((0x21, 0x7E))
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_SIGN = byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_MANY = byte_set((0x80, 0xFF))
#: First bytes of the characters beyond ASCII that are white space, among others.
_MAY_LEAD_SPACE = byte_set((0xC2, 0xC2), (0xE1, 0xE3))
_SOLID_LEAD = _GRAPHIC | byte_set((0xC3, 0xE0), (0xE4, 0xFF))


def piece_starts(chunk: Chunk) -> np.ndarray:
    """The places at which the chunk is cut, ends of texts among them."""
    n = len(chunk.buf) - PAD
    b = chunk.buf[:n]
    cut = np.zeros(n + 1, dtype=bool)
    if n > 1:
        graphic, space = _GRAPHIC[b], _SPACE[b]
        lead = _MAY_LEAD_SPACE[b]
        solid = _MANY[b]
        solid[1:] &= ~lead[:-1]
        solid[2:] &= ~lead[:-2]
        solid &= ~lead
        solid |= graphic
        cut[1:n] |= space[1:] & solid[:-1]
        if n > 2:
            cut[2:n] |= (b[1:-1] == 0x0A) & solid[:-2] & _SOLID_LEAD[b[2:]]
        letter, sign = _LETTER[b], _SIGN[b]
        cut[1:n] |= (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
    cut[chunk.offsets] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Encodes chunks with a tokenizers file; ``drops_space`` for files whose ids ignore it and case."""

    def __init__(self, path: str, drops_space: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.drops_space = drops_space
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= 65_536 else np.uint32)

    def _library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes, flat = np.zeros(len(pieces), np.int32), []
        for lo in range(0, len(pieces), 4096):
            for i, e in enumerate(self.tokenizer.encode_batch_fast(pieces[lo : lo + 4096], add_special_tokens=False)):
                ids = e.ids
                sizes[lo + i] = len(ids)
                flat.extend(ids)
        return sizes, np.array(flat, dtype=self.ids.dtype)

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk end to end, and where each text's begin (one more at the end)."""
        edges = piece_starts(chunk)
        starts, lengths = edges[:-1], np.diff(edges)
        if self.drops_space and len(starts):
            lead = _SPACE[chunk.buf[starts]]
            starts, lengths = starts + lead, lengths - lead
            full = lengths > 0
            starts, lengths = starts[full], lengths[full]
        first_piece = np.searchsorted(starts, chunk.offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(chunk.rows + 1, np.int64)
        h = span_hashes(chunk.buf, starts, lengths)
        codes, distinct = pd.factorize(h)
        where = np.empty(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.keys) > TABLE_ENTRIES:
            self._reset()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        known &= lengths[where] <= LONGEST_CACHED
        fresh = np.flatnonzero(~known)
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int32)
        begin[known], size[known] = self.begin[at[known]], self.size[at[known]]
        raw = chunk.buf.tobytes()
        lo, hi = starts[where[fresh]].tolist(), (starts + lengths)[where[fresh]].tolist()
        sizes, flat = self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(lo, hi)])
        size[fresh] = sizes
        begin[fresh] = len(self.ids) + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(fresh) else 0
        pool = np.concatenate([self.ids, flat])
        keep = fresh[lengths[where[fresh]] <= LONGEST_CACHED]
        if len(keep):
            order = np.argsort(distinct[keep])
            keep = keep[order]
            into = np.searchsorted(self.keys, distinct[keep])
            self.keys = np.insert(self.keys, into, distinct[keep])
            self.begin = np.insert(self.begin, into, begin[keep])
            self.size = np.insert(self.size, into, size[keep])
        self.ids = pool
        per = size[codes].astype(np.int64)
        ends = np.cumsum(per)
        index = np.arange(ends[-1]) + np.repeat(begin[codes] - (ends - per), per)
        bounds = np.concatenate([[0], ends])[first_piece]
        return pool[index], bounds


@lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool = False) -> PieceEncoder:
    """One encoder for each worker and file."""
    return PieceEncoder(path, drops_space)

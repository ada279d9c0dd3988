"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut before they reach the library, only where its pattern always
ends a match: before a single space or a line break that follows a character
other than white space. So the ids are those of the whole text, and the
library's recursion and memory stay bounded by ``segment`` characters unless a
text has no such place. Ids decode to raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents

SEGMENT_CHARS = 65_536
#: White space starts after a letter, digit or sign of ASCII: a match of the pattern always ends there.
_SAFE = re.compile(r"(?<=[!-~])[ \n]")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN):
    """The library's encoding for a rank file, made once for each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = SEGMENT_CHARS) -> list[str]:
    """Cut a text at safe places into pieces of about ``size`` characters."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


def encode(text: str, path: str, size: int = SEGMENT_CHARS) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    enc = encoding(path)
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(s), dtype="<u4") for s in segments(text, size)])


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of the ids; any ids, also such as end inside a character."""
    return encoding(path).decode_bytes(ids.tolist())


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; a null text is empty and has no ids."""

    def run(batches):
        for batch in batches:
            ids = [encode(t, path) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text; one row for each row of ``docs`` with digests of both.

    Null and empty texts have no tokens and the digest of no bytes. Rows keep null
    or repeated ids as they are; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                count, of_ids, of_bytes = [], [], []
                for text in pc.fill_null(part.column("text"), "").to_pylist():
                    ids = encode(text, path)
                    count.append(len(ids))
                    of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    of_bytes.append(hashlib.sha256(decode(ids, path)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

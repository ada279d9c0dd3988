"""Best-fit packing of documents into fixed-length sequences under several capacities.

Every sequence has room for so many tokens, documents and attention cost (the
sum of squared lengths). Lengths are placed in falling order; an item goes to
the feasible sequence with the best score, the smallest weighted norm of what is
left (``score="norm"``) or the largest weighted dot product of demand and room
(``score="dot"``). What a placement needs of an item is its length alone, so the
plan is made over the counts of lengths: sequences with the same room form a
class with contiguous numbers, placed into together. The plan is bounded by the
sequence length, not by the corpus; rows then find their place in it by their
rank among those of equal length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, documents, partitions
from quarry.llm.piece_cache import encoder
from quarry.llm.textkernel import BATCH_BYTES, chunks


#: Tokens of a sequence, and documents in one where that makes no more sequences.
TOKENS, DOCUMENTS = 2048, 64


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; None: no limit beyond what the tokens imply."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None


@dataclass
class Plan:
    """Slots: ranks ``rank`` onward of ``length`` fill ``bins`` sequences from ``sequence``, ``each`` to one, from ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    bins: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def vector_best_fit(counts: dict[int, int], capacity: Capacity, score: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> Plan:
    """Place counted lengths; each length must fit an empty sequence."""
    full = np.array([capacity.tokens, capacity.documents or capacity.tokens, capacity.attention or capacity.tokens**2], dtype=np.float64)
    weight = np.array(weights)
    room = np.zeros((64, 3))
    first, size = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used, total, slots = 0, 0, []

    def add(r, f, m):
        nonlocal room, first, size, used
        if used == len(first):
            room, first, size = np.vstack([room, np.zeros_like(room)]), np.concatenate([first, first * 0]), np.concatenate([size, size * 0])
        room[used], first[used], size[used] = r, f, m
        used += 1

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], dtype=np.float64)
        if (need > full).any():
            raise ValueError(f"length {length} doesn't fit an empty sequence")
        while left:
            fits = np.flatnonzero((size[:used] > 0) & (room[:used] >= need).all(axis=1))
            if len(fits):
                rest = room[fits] - need
                value = -((rest / full) ** 2 @ weight) if score == "norm" else (room[fits] / full) @ (weight * need / full)
                k = fits[int(np.argmax(value))]
                r, f, m = room[k].copy(), first[k], size[k]
            else:
                r, f, m = full.copy(), total, -1
            each = int(min(r // need)) if score == "norm" or m < 0 else 1
            if each > left:
                each = left
            bins = left // each if m < 0 else min(m, left // each)
            slots.append((length, rank, f, bins, each, int(full[0] - r[0])))
            if m < 0:
                total += bins
            else:
                first[k], size[k] = f + bins, m - bins
                if size[k] == 0:  # the last class takes its place
                    used -= 1
                    room[k], first[k], size[k] = room[used], first[used], size[used]
            after = r - each * need
            if after[0] >= 1 and after[1] >= 1 and after[2] >= 1:
                add(after, f, bins)
            left -= bins * each
            rank += bins * each
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)
    return Plan(*(table[:, i] for i in range(6)), sequences=total)


def fewest(counts: dict[int, int], capacities: tuple[Capacity, ...], scores: tuple[str, ...] = ("norm", "dot")) -> Plan:
    """The plan with the fewest sequences over all capacities and scores; of equals the first."""
    plans = [vector_best_fit(counts, c, s) for c in capacities for s in scores]
    return min(plans, key=lambda p: p.sequences)


def encode_pieces(docs: DataFrame, path: str, tokens: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append the end id and cut those longer than ``tokens``; the first piece may be shorter."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for c in chunks(batch.column("text"), BATCH_BYTES):
                ids, bounds = enc.encode(c)
                rows = ([], [], [], [], [])
                keys = batch.column("doc_id").slice(c.lo, c.rows).to_pylist()
                for i, key in enumerate(keys):
                    own = np.append(ids[bounds[i] : bounds[i + 1]].astype("<u4"), np.uint32(end_id))
                    short = len(own) % tokens
                    edges = [0, *range(short or tokens, len(own) + 1, tokens)]
                    for p, (a, b) in enumerate(zip(edges, edges[1:])):
                        for out, v in zip(rows, (key, p, a, b - a, zlib.crc32(own[a:b]))):
                            out.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacities: tuple[Capacity, ...], scores: tuple[str, ...] = ("norm", "dot")) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length``; ``pieces`` should be cheap to read twice."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # bounded by the tokens of a sequence
    plan = fewest(counts, capacities, scores)
    salts = partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "salt", "base")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("k"))
    columns = pieces.columns
    shape = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    slots = spark.sparkContext.broadcast((plan.length, plan.rank, plan.sequence, plan.each, plan.offset))

    def run(batches):
        length, rank, sequence, each, offset = slots.value
        key = length * (1 << 48) + rank
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, n * (1 << 48) + r, side="right") - 1
            i = r - rank[at]
            seq, off = sequence[at] + i // each[at], offset[at] + (i % each[at]) * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(seq), pa.array(off)], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(run, f"{shape}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacities: tuple[Capacity, ...] | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and pack all documents; one row for each piece.

    The plan is the one with the fewest sequences over ``capacities`` and both
    scores; all must hold as many tokens. By default a sequence has at most
    DOCUMENTS documents and the attention cost of one full piece, unless only more
    documents in one make fewer sequences.

    A null text counts as empty and is packed as its end id alone; an empty table
    gives no rows; rows with equal or null ids are packed each on its own; other
    columns are not read. Pieces are written once, so that no text is encoded twice.
    """
    capacities = capacities or (Capacity(TOKENS, DOCUMENTS, TOKENS**2), Capacity(TOKENS, None, TOKENS**2))
    return place(cut(encode_pieces(docs, path, capacities[0].tokens, end_id, id_col, text_col)), capacities)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))

"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of terms over its whole length, weighted by inverse document
frequency and scaled to a unit vector. Terms are hashed byte trigrams, with damped
counts, and repeats: a word that stood one, two, three or four words before, and a
line that stood one before. A truncated singular value decomposition of a bounded
sample of labelled texts maps the terms to a short unit vector. The labelled
vectors are broadcast (their number is the bounded parameter ``examples``), and
blocks of documents get exact cosine products with all of them; the nearest vote
with weights by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, fold
from quarry.llm.textkernel import PAD, WORD_SEPARATORS, Chunk, byte_set, chunks, span_hashes, words

FEATURES, DIMENSIONS, EXAMPLES, NEIGHBOURS = 2048, 48, 4000, 15
#: Exponent of the similarity in a vote, and weight of the prior.
SHARPNESS, PRIOR_WEIGHT = 8.0, 0.05
BLOCK = 256
#: Words between repeats that count; lines count next to each other.
LAGS = (1, 2, 3, 4)
TERMS = FEATURES + len(LAGS) + 1

_NEWLINE = byte_set((0x0A, 0x0A))


def _repeats(chunk: Chunk, separators: np.ndarray, lags: tuple[int, ...]) -> list[np.ndarray]:
    """For each lag how many of each text's words (or lines) equal the one so many before."""
    starts, lengths, bounds = words(chunk, separators)
    h = span_hashes(chunk.buf, starts, lengths)
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    return [np.bincount(row[k:][(h[k:] == h[:-k]) & (row[k:] == row[:-k])], minlength=chunk.rows) for k in lags]


def term_counts(chunk: Chunk) -> np.ndarray:
    """Counts (rows, TERMS): damped ones of hashed byte trigrams, none for a text of one or two bytes, then repeats."""
    n = len(chunk.buf) - PAD
    b = chunk.buf[: n + 2].astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    cell = (h >> np.uint32(21)).astype(np.int64)
    out = np.zeros((chunk.rows, TERMS), np.float32)
    for i in range(chunk.rows):
        a, z = chunk.offsets[i], max(chunk.offsets[i + 1] - 2, chunk.offsets[i])
        if z > a:
            out[i, :FEATURES] = np.bincount(cell[a:z], minlength=FEATURES)
    np.log1p(out, out=out)
    out[:, FEATURES:] = np.stack([*_repeats(chunk, WORD_SEPARATORS, LAGS), *_repeats(chunk, _NEWLINE, (1,))], axis=1)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors."""
    x = counts * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = weighted(counts, self.idf) @ self.project
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of label 1 among the nearest; the prior for texts without features."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cos = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < cos.shape[1] else np.tile(np.arange(k), (len(cos), 1))
        w = np.clip(np.take_along_axis(cos, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
        return ((w * self.labels[near]).sum(axis=1) + PRIOR_WEIGHT * self.prior) / (w.sum(axis=1) + PRIOR_WEIGHT)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, examples: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and ``y`` of at most ``examples`` labelled rows whose fold isn't 0, dealt by a hash of the id.

    Of several texts with one id the first in their order stands for it.
    """
    chosen = labels.where(F.col(label).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("double")).alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(examples)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = rows.join(F.broadcast(chosen), rows["id"] == chosen["__id"])  # bounded by ``examples``
    return found.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``examples`` labelled rows outside the held-out fold."""

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), 1 << 20):
                rows = [r.tobytes() for r in term_counts(c)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.lo, c.rows), pa.array(rows, pa.binary()), batch.column("y").slice(c.lo, c.rows)], ["id", "x", "y"])

    sample = labelled_sample(docs, labels, label, examples, id_col, text_col).select(F.col("id").cast("long"), "text", "y")
    got = sorted(sample.mapInArrow(run, "id long, x binary, y double").collect())  # bounded by ``examples``
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float32).reshape(-1, TERMS)
    y = np.array([r["y"] for r in got], np.float64)
    n = len(y)
    idf = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    prior = float(y.mean()) if n else 0.5
    if not n:
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, prior)
    counts, x = x, weighted(x, idf)
    rank = min(DIMENSIONS, n, TERMS)
    rng = np.random.default_rng(11)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], min(rank + 16, n, TERMS)), dtype=np.float32))[0]
    for _ in range(4):  # subspace iterations of the randomised decomposition
        q = np.linalg.qr(x @ (x.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    model = Model(idf, np.ascontiguousarray(vt[:rank].T), np.zeros((0, rank), np.float32), y, prior)
    model.vectors = model.embed(counts)
    return model


def classify(docs: DataFrame, model: Model, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: one row for each row of ``docs`` with doc_id, held_out, score and predicted.

    Null and empty texts get the prior; held_out is null for a null id; repeated
    rows are scored alike. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``examples``

    def run(batches):
        m = shared.value
        for batch in batches:
            for c in chunks(batch.column("text"), 1 << 20):
                counts = term_counts(c)
                score = np.concatenate([m.score(counts[i : i + BLOCK]) for i in range(0, c.rows, BLOCK)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.lo, c.rows), pa.array(np.clip(score, 0, 1))], ["doc_id", "score"])

    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, fit(docs, labels), 0.3)

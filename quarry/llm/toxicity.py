"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

A text is a vector over all its words and word starts, weighted by damped counts,
inverse document frequency, and relevance frequency (how many examples with the
label have the feature for each one without). A bounded sample of labelled rows of both labels is indexed
by posting lists, whose examples are in blocks with the largest weight of each
block. A query first adds up the postings of its rarer features; the longest lists
are bounded by block, and only blocks that can still hold one of the nearest are
completed, so the neighbours are exact. Their votes, weighted by
similarity, are calibrated by votes on rows that were left out of the index; the
neighbours' ids and what the query shares with them are the evidence.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, fold
from quarry.llm.quality import labelled_sample
from quarry.llm.textkernel import Chunk, byte_set, chunks, span_hashes, words

EXAMPLES, NEIGHBOURS, BLOCK = 3000, 15, 64
#: Bytes of the word starts; 0: the whole word.
STARTS = (0, 4, 5, 6)
#: Exponent of the similarity in a vote, and votes by the rate of the label that every text has.
SHARPNESS, SMOOTHING = 2.0, 1e-3
#: Parts of the sample that are left out in turn for the calibration.
PARTS = 5
#: Queries whose products with all examples are held at once.
QUERIES = 64
#: A feature's list is long if more than one example in so many has it.
LONG = 20
EVIDENCE = 5

#: Everything but ASCII letters and the bytes of other characters separates words.
_NOT_LETTERS = ~byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def feature_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all features of a lower-cased chunk with the row, place and length of each."""
    starts, lengths, bounds = words(chunk, _NOT_LETTERS)
    row = np.repeat(np.arange(chunk.rows), np.diff(bounds))
    out = []
    for i, size in enumerate(STARTS):
        pick = slice(None) if not size else lengths > size
        s, n = starts[pick], lengths[pick]
        n = n if not size else np.full(len(s), size)
        h = span_hashes(chunk.buf, s, n) ^ np.uint64(i)  # a word start is another feature than the same whole word
        out.append((h, row[pick], s, n))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Counted:
    """Distinct features of the texts of a chunk, text by text: hash, count, and where one stands."""

    hashes: np.ndarray
    counts: np.ndarray
    start: np.ndarray
    length: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(chunk: Chunk) -> Counted:
        h, row, start, length = feature_hashes(chunk)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(h)))
        return Counted(h[first], counts, start[order[first]], length[order[first]], np.searchsorted(row[first], np.arange(chunk.rows + 1)))


class BlockMaxIndex:
    """Posting lists of sparse vectors, with the largest weight of each long list in each block of examples.

    Lists that more than one example in LONG has are kept by block as dense rows, all
    others as postings.
    """

    def __init__(self, feature: np.ndarray, example: np.ndarray, weight: np.ndarray, features: int, examples: int, block: int = BLOCK):
        self.examples, self.block, self.blocks = examples, block, -(-examples // block)
        # the vectors themselves, by example and feature
        by = np.lexsort((feature, example)).astype(np.int32)
        self.of, self.own_weight = feature[by].astype(np.int32), weight[by].astype(np.float32)
        self.own_first = np.searchsorted(example[by], np.arange(examples + 1))
        df = np.bincount(feature, minlength=features)
        self.example_at = self._like_together(df)
        place_of = np.argsort(self.example_at)
        # long lists: a dense row for each place, and the largest weights of each block
        long = np.flatnonzero(df * LONG > examples)
        self.column = np.full(features, -1, np.int32)
        self.column[long] = np.arange(len(long))
        dense = self.column[feature] >= 0
        self.rows = np.zeros((examples, len(long)), np.float32)
        self.rows[place_of[example[dense]], self.column[feature[dense]]] = weight[dense]
        starts = np.arange(0, examples, block)
        self.most = np.maximum.reduceat(self.rows, starts, axis=0) if examples else np.zeros((0, len(long)), np.float32)
        # all others: postings by feature
        short = np.flatnonzero(~dense)
        short = short[np.argsort(feature[short], kind="stable")]
        self.place, self.weight = place_of[example[short]].astype(np.int32), weight[short].astype(np.float32)
        self.size = np.where(self.column < 0, df, 0)
        self.first = np.cumsum(self.size) - self.size

    def _like_together(self, df: np.ndarray) -> np.ndarray:
        """The examples by their strongest feature among those that many have: what is alike shares blocks."""
        w = np.where(df[self.of] >= max(2, self.examples // 20), self.own_weight, np.float32(0))
        row = np.repeat(np.arange(self.examples, dtype=np.int32), np.diff(self.own_first))
        by = np.lexsort((-w, row)).astype(np.int32)
        strongest = np.full(self.examples, -1, np.int64)
        have = np.diff(self.own_first) > 0
        strongest[have] = self.of[by[self.own_first[:-1][have]]]
        return np.lexsort((np.arange(self.examples), strongest))

    def nearest(self, row: np.ndarray, features: np.ndarray, weights: np.ndarray, rows: int, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``rows`` queries, given as (row, feature, weight) by row, the k nearest by dot product among those that share a feature.

        Ties go by the number of the example. QUERIES of them are searched at once.
        """
        if not self.examples:
            return [(np.zeros(0, np.int64), np.zeros(0))] * rows
        if rows > QUERIES:
            out = []
            for lo in range(0, rows, QUERIES):
                a, b = np.searchsorted(row, (lo, lo + QUERIES))
                out += self.nearest(row[a:b] - lo, features[a:b], weights[a:b], min(QUERIES, rows - lo), k)
            return out
        size = self.size[features]
        at = np.repeat(self.first[features] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        total = np.bincount(np.repeat(row * self.examples, size) + self.place[at], weights=self.weight[at] * np.repeat(weights, size), minlength=rows * self.examples).astype(np.float64).reshape(rows, self.examples)
        column = self.column[features]
        long = np.flatnonzero(column >= 0)
        query = np.zeros((rows, self.rows.shape[1]), np.float32)
        query[row[long], column[long]] = weights[long]
        # a block is completed for the queries that it can still hold one of the nearest of
        k_ = min(k, self.examples)
        enough = np.partition(total, -k_, axis=1)[:, -k_]
        best = np.maximum.reduceat(total, np.arange(0, self.examples, self.block), axis=1)
        alive = best + query @ self.most.T >= enough[:, None] - 1e-5
        for i in range(self.blocks):
            who = np.flatnonzero(alive[:, i])
            span = slice(i * self.block, (i + 1) * self.block)
            if len(who):
                total[who, span] += query[who] @ self.rows[span].T
        total[np.repeat(~alive, self.block, axis=1)[:, : self.examples]] = 0
        least = np.partition(total, -k_, axis=1)[:, -k_]
        out = []
        for t, x in zip(total, least):
            found = np.flatnonzero((t >= x - 1e-6) & (t > 0))
            found = found[np.lexsort((self.example_at[found], -np.round(t[found], 6)))][:k]
            out.append((self.example_at[found], t[found]))
        return out


@dataclass
class Model:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    unknown: float = 0.0
    index: BlockMaxIndex = field(default_factory=lambda: BlockMaxIndex(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0, 0))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rate: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def vectors(self, row: np.ndarray, hashes: np.ndarray, counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and weights of the known features of unit vectors, and which of the given they are."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == hashes
        w = (1 + np.log(counts)) * np.where(known, self.weight[at], self.unknown)
        norm = np.sqrt(np.bincount(row, weights=w * w, minlength=rows))
        pick = np.flatnonzero(known)
        return at[pick], w[pick] / norm[row[pick]], pick

    def votes(self, row: np.ndarray, features: np.ndarray, weights: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The share of the label among the nearest of each query, weighted by similarity, and the nearest."""
        near = self.index.nearest(row, features, weights, rows, NEIGHBOURS)
        votes = np.empty(rows)
        for i, (at, cos) in enumerate(near):
            w = cos**SHARPNESS
            votes[i] = ((w * self.labels[at]).sum() + SMOOTHING * self.rate) / (w.sum() + SMOOTHING)
        return votes, [at for at, _ in near]

    def calibrated(self, vote: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * vote + self.shift)))

    def scores(self, chunk: Chunk, evidence: bool = True) -> tuple[np.ndarray, list[list[str]], list[list[int]]]:
        """Calibrated scores of the texts of a lower-cased chunk, the strongest terms shared with the nearest example, and the nearest ids."""
        q = Counted.of(chunk)
        row = np.repeat(np.arange(chunk.rows), np.diff(q.edges))
        features, weights, pick = self.vectors(row, q.hashes, q.counts, chunk.rows)
        row = row[pick]
        votes, nearest = self.votes(row, features, weights, chunk.rows)
        terms, near = [[] for _ in nearest], [self.ids[at[:EVIDENCE]].tolist() for at in nearest]
        edges = np.searchsorted(row, np.arange(chunk.rows + 1))
        for i, at in enumerate(nearest if evidence else ()):
            if len(at):
                a, b = self.index.own_first[at[0] : at[0] + 2]
                lo, hi = edges[i], edges[i + 1]
                own = self.index.of[a:b]
                place = np.minimum(np.searchsorted(own, features[lo:hi]), len(own) - 1)
                shared = np.where(own[place] == features[lo:hi], weights[lo:hi] * self.index.own_weight[a:b][place], 0)
                for j in pick[lo:hi][np.argsort(-shared, kind="stable")[:EVIDENCE]][: int((shared > 0).sum())]:
                    terms[i].append(chunk.buf[q.start[j] : q.start[j] + q.length[j]].tobytes().decode("utf-8", "ignore"))
        return self.calibrated(votes), terms, near


def _index(example: np.ndarray, hashes: np.ndarray, counts: np.ndarray, labels: np.ndarray, ids: np.ndarray) -> Model:
    """Weights and index of examples given as (example, feature, count)."""
    n = len(labels)
    names, feature = np.unique(hashes, return_inverse=True)
    feature = feature.astype(np.int32)
    df = np.bincount(feature, minlength=len(names)).astype(np.float64)
    with_label = np.bincount(feature, weights=labels[example], minlength=len(names))
    idf = np.log((1 + n) / (1 + df)) + 0.01
    # relevance frequency: how many examples with the label have the feature for each one without
    weight = idf * np.log2(2 + with_label / np.maximum(df - with_label, 1))
    w = ((1 + np.log(counts)) * weight[feature]).astype(np.float32)
    norm = np.sqrt(np.bincount(example, weights=w * w, minlength=n))
    w /= np.maximum(norm, 1e-12).astype(np.float32)[example]
    return Model(names, weight, float(np.log(1 + n) + 0.01), BlockMaxIndex(feature, example, w, len(names), n), labels, ids, float(labels.mean()) if n else 0.0)


def _calibration(votes: np.ndarray, labels: np.ndarray, rounds: int = 50, prior: float = 0.01) -> tuple[float, float]:
    """Slope and shift of the logistic curve of the label by the vote, by Newton steps."""
    x = np.stack([votes, np.ones(len(votes))], 1)
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (labels - p) - prior * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior * np.eye(2), gradient)
        beta += np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``examples`` labelled rows outside the held-out fold.

    Equal texts count once, as the row with the smallest id. Each of PARTS parts
    is left out of an index in turn and scored by it, which gives the votes that
    the calibration is made from.
    """
    sample = labelled_sample(docs, labels, label, examples, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text", "y")
    apart = sample.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("id").alias("id"), F.min_by("y", "id").alias("y"))

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                q = Counted.of(c)
                pairs = list(zip(q.edges[:-1].tolist(), q.edges[1:].tolist()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(c.lo, c.rows), batch.column("y").slice(c.lo, c.rows), pa.array([q.hashes[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([q.counts[a:b].astype("<u4").tobytes() for a, b in pairs], pa.binary())], ["id", "y", "h", "n"])

    # the features of at most ``examples`` texts
    got = apart.select("id", "text", "y").mapInArrow(run, "id long, y double, h binary, n binary").toArrow().sort_by("id")
    y, ids = got.column("y").to_numpy(), got.column("id").to_numpy()
    if not len(y) or not 0 < y.sum() < len(y):
        rate = float(y.mean()) if len(y) else 0.0
        return Model(rate=rate, slope=0.0, shift=float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    size = [x.as_buffer().size // 8 for x in got.column("h")]
    h, n = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in got.column(name)]) for name, kind in (("h", np.uint64), ("n", "<u4")))
    del got
    example = np.repeat(np.arange(len(y), dtype=np.int32), size)
    edges = np.searchsorted(example, np.arange(len(y) + 1))
    part, votes = np.arange(len(y)) % PARTS, np.zeros(len(y))
    for p in range(PARTS):
        inside = np.flatnonzero(part != p)
        number = (np.cumsum(part != p) - 1).astype(np.int32)
        pick = part[example] != p
        model = None  # one index at a time
        model = _index(number[example[pick]], h[pick], n[pick], y[inside], ids[inside])
        for out in np.array_split(np.flatnonzero(part == p), -(-len(y) // (64 * PARTS))):
            mine = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in out]) if len(out) else np.zeros(0, np.int64)
            row = np.searchsorted(out, example[mine])
            features, weights, pick = model.vectors(row, h[mine], n[mine], len(out))
            votes[out] = model.votes(row[pick], features, weights, len(out))[0]
    model = None
    model = _index(example, h, n, y, ids)
    model.slope, model.shift = _calibration(votes, y)
    return model


def classify(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: doc_id, held_out, score, predicted, and as evidence terms and neighbours.

    Null and empty texts, and texts that share no feature with any example, get the
    calibrated rate of the label; held_out is null for a null id; repeated rows are
    scored alike; an empty table gives no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by ``examples``

    def run(batches):
        for batch in batches:
            for c in chunks(batch.column("text"), lower=True):
                score, terms, near = shared.value.scores(c)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(c.lo, c.rows), pa.array(score, pa.float64()), pa.array(terms, pa.list_(pa.string())), pa.array(near, pa.list_(pa.int64()))], ["doc_id", "score", "terms", "neighbours"])

    scored = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, terms array<string>, neighbours array<long>")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms", "neighbours")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score below the threshold, all columns as they are.

    Null and empty texts have the calibrated rate of the label and stay as long as
    that is below the threshold; repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            keep = [shared.value.scores(c, False)[0] < threshold for c in chunks(texts.cast(pa.string()), lower=True)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, fit(docs, labels), 0.5)

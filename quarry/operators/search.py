"""Exact, byte-wise, overlapping search by a parallel scan.

A few needles are tested by the JVM as the corpus streams past them; more, and all
places of hits, are found by one automaton over all needles, in time linear in the
text and its hits. Needles are a short list by nature; they are broadcast in parts
of at most NEEDLE_BYTES, each of which is one more pass over the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import count_overlapping, n_bytes
from quarry.sources import with_next

#: Bytes of needles that are broadcast at once, and needles up to which the JVM tests each by itself.
NEEDLE_BYTES, FEW = 8 << 20, 12
#: Hits shown with context for a query, and bytes of context on each side.
CONTEXT_HITS, CONTEXT_BYTES = 64, 128
#: Rows that a worker hands on at once, and bytes of first suffixes that it keeps.
BATCH, HELD_BYTES = 1 << 15, 16 << 20


def _checked(needles: DataFrame) -> DataFrame:
    """Needles; an empty one is an error, as it would match everywhere."""
    return needles.withColumn("query", F.when(F.col("query") == "", F.raise_error(F.lit("an empty needle matches everywhere"))).otherwise(F.col("query")))


def _spread(corpus: DataFrame) -> DataFrame:
    """Rows over all cores: a file with one row group would be one task."""
    if corpus.isStreaming:
        return corpus
    spark = corpus.sparkSession
    have = corpus.rdd.getNumPartitions()
    want = max(spark.sparkContext.defaultParallelism, 2)
    return corpus.repartition(want) if have < want else corpus


def _parts(needles: DataFrame) -> Iterator[list[tuple]]:
    """(query_id, query) in parts of at most NEEDLE_BYTES (or one needle); the driver holds one part at a time."""
    part, size = [], 0
    for r in _checked(needles).select("query_id", "query").toLocalIterator():
        n = len(r["query"].encode())
        if part and size + n > NEEDLE_BYTES:
            yield part
            part, size = [], 0
        part.append((r["query_id"], r["query"]))
        size += n
    if part:
        yield part


class _Automaton:
    """All needles of a part; equal ones share a place."""

    def __init__(self, part: list[tuple]):
        self.ids: dict[str, list] = {}
        for i, q in part:
            self.ids.setdefault(q, []).append(i)
        self.needles = list(self.ids)
        self.machine = ahocorasick.Automaton()
        for k, q in enumerate(self.needles):
            self.machine.add_word(q, k)
        self.machine.make_automaton()

    def found(self, text: str) -> set[int]:
        return {k for _, k in self.machine.iter(text)}

    def hits(self, text: str) -> dict[int, np.ndarray]:
        """Byte offsets of all occurrences of each needle, ascending."""
        got = list(self.machine.iter(text))
        if not got:
            return {}
        ends, kind = np.array(got, np.int64).T
        starts = ends + 1 - np.array([len(q) for q in self.needles])[kind]
        if not text.isascii():
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            starts = np.concatenate([[0], np.cumsum(width)])[starts]
        order = np.lexsort((starts, kind))
        kind, starts = kind[order], starts[order]
        cut = np.flatnonzero(np.diff(kind)) + 1
        return dict(zip(kind[np.concatenate([[0], cut])].tolist(), np.split(starts, cut)))


def _types(needles: DataFrame) -> tuple[str, pa.DataType]:
    kind = dict(needles.dtypes)["query_id"]
    return kind, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]


def _scan(corpus: DataFrame, needles: DataFrame, columns: str, rows: Callable[[_Automaton, int, str], Iterator[tuple]], types: list[pa.DataType], extra: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, *columns) that ``rows`` gives for each text of the corpus (uid, text, *extra), in batches of bounded size."""
    spark, (kind, arrow) = corpus.sparkSession, _types(needles)
    names = ["query_id", *(c.split()[0] for c in columns.split(", "))]
    shape = f"query_id {kind}, {columns}"
    out = None
    for part in _parts(needles):
        shared = spark.sparkContext.broadcast(part)  # at most NEEDLE_BYTES, or one needle

        def run(batches, shared=shared):
            machine, held = _Automaton(shared.value), []

            def flush():
                cols = list(zip(*held))
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [arrow, *types])], names)

            for batch in batches:
                cols = [batch.column("uid").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist(), *(batch.column(c).to_pylist() for c in extra)]
                for row in zip(*cols):
                    for k, *made in rows(machine, *row):
                        for i in machine.ids[machine.needles[k]]:
                            held.append((i, *made))
                            if len(held) >= BATCH:
                                yield flush()
            if held:
                yield flush()

        one = _spread(corpus).select("uid", "text", *extra).mapInArrow(run, shape)
        out = one if out is None else out.unionAll(one)
    return corpus.sparkSession.createDataFrame([], shape) if out is None else out


def _few(needles: DataFrame) -> bool:
    """Whether the needles are few, and small enough to be broadcast."""
    n, size = needles.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("query")), F.lit(0))).first()
    return n <= FEW and size <= NEEDLE_BYTES


def hit_counts(corpus: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, uid, n): occurrences of each needle in each document that holds it, of a table or a stream."""
    if _few(needles):
        found = _spread(corpus).join(F.broadcast(_checked(needles).select("query_id", "query")), F.contains("text", "query"))
        return found.select("query_id", "uid", count_overlapping(F.col("text"), F.col("query")).alias("n"))
    return _scan(corpus, needles, "uid long, n long", lambda m, uid, text: ((k, uid, len(at)) for k, at in m.hits(text).items()), [pa.int64(), pa.int64()])


def matches(corpus: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, query, uid, text) of each document that holds a needle.

    Up to FEW needles of together at most NEEDLE_BYTES meet the corpus in a
    broadcast join on ``contains``; more of them in one automaton, a pass over the
    corpus for each part.
    """
    if _few(needles):
        return _spread(corpus).join(F.broadcast(_checked(needles).select("query_id", "query")), F.contains("text", "query")).select("query_id", "query", "uid", "text")
    found = _scan(corpus, needles, "query string, uid long, text string", lambda m, uid, text: ((k, m.needles[k], uid, text) for k in m.found(text)), [pa.string(), pa.int64(), pa.string()])
    return found.select("query_id", "query", "uid", "text")


def pairs(corpus: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, uid) of each document that holds a needle, by one automaton; no text leaves the scan."""
    return _scan(corpus, needles, "uid long", lambda m, uid, text: ((k, uid) for k in m.found(text)), [pa.int64()])


def count(corpus: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, query, occurrences) of every needle; 0 where there is none."""
    found = hit_counts(corpus, needles).groupBy("query_id").agg(F.sum("n").alias("n"))
    return needles.join(found, "query_id", "left").select("query_id", "query", F.coalesce("n", F.lit(0)).cast("long").alias("occurrences"))


def count_of(corpus: DataFrame, needle: str) -> DataFrame:
    """(occurrences) of one needle: no join, the count is summed before the shuffle."""
    if not needle:
        raise ValueError("an empty needle matches everywhere")
    return _spread(corpus).agg(F.coalesce(F.sum(count_overlapping(F.col("text"), F.lit(needle))), F.lit(0)).alias("occurrences"))


def document_frequency(corpus: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, query, documents) that hold each needle."""
    found = (matches if _few(needles) else pairs)(corpus, needles).groupBy("query_id").agg(F.countDistinct("uid").alias("n"))
    return needles.join(found, "query_id", "left").select("query_id", "query", F.coalesce("n", F.lit(0)).cast("long").alias("documents"))


def positions(corpus: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, query, uid, pos) of every occurrence; pos is its byte offset in the body, from 0."""

    def rows(m, uid, text):
        for k, at in m.hits(text).items():
            for p in at.tolist():
                yield k, m.needles[k], uid, p

    return _scan(corpus, needles, "query string, uid long, pos long", rows, [pa.string(), pa.int64(), pa.int64()])


def contains(corpus: DataFrame, needle: str) -> DataFrame:
    """The documents that hold a needle; an empty needle is in none."""
    return corpus.where(F.contains("text", F.lit(needle))) if needle else corpus.where(F.lit(False))


def kwic(corpus: DataFrame, needles: DataFrame, width: int = CONTEXT_BYTES) -> DataFrame:
    """(query_id, query, uid, pos, before, after): bytes on each side, cut at the ends of the document."""

    def rows(m, uid, text):
        body = text.encode("utf-8", "surrogatepass")
        for k, at in m.hits(text).items():
            n = len(m.needles[k].encode())
            for p in at.tolist():
                yield k, m.needles[k], uid, p, body[max(p - width, 0) : p], body[p + n : p + n + width]

    return _scan(corpus, needles, "query string, uid long, pos long, before binary, after binary", rows, [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()])


#: Bytes by which suffixes are told apart at first, and ties that are then compared whole.
FIRST_BYTES, TIES = 64, 512


def _suffix_ranks(body: bytes) -> np.ndarray:
    """The rank of every suffix of a body, by prefix doubling."""
    rank = np.frombuffer(body, np.uint8).astype(np.int64) + 1
    step, n = 1, len(rank)
    while step < n:
        key = rank * (n + 257)
        key[: n - step] += rank[step:]
        distinct, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        if len(distinct) == n:
            break
        step *= 2
    return rank


def first_suffixes(body: bytes, at: np.ndarray, most: int) -> list[int]:
    """The ``most`` places of ``at`` whose suffixes come first, in their order."""
    if len(at) > most:
        heads = [body[p : p + FIRST_BYTES] for p in at.tolist()]
        last = heapq.nsmallest(most, heads)[-1]
        at = np.array([p for p, h in zip(at.tolist(), heads) if h <= last], np.int64)
        if len(at) > most + TIES or len(at) * len(body) > HELD_BYTES:  # many alike at first, or long: rank all suffixes of the body once
            rank = _suffix_ranks(body)
            return at[np.argsort(rank[at], kind="stable")[:most]].tolist()
    return sorted(at.tolist(), key=lambda p: body[p:])[:most]


def kwic_top(corpus: DataFrame, needles: DataFrame, hits: int = CONTEXT_HITS, width: int = CONTEXT_BYTES, key_bytes: int | None = None) -> DataFrame:
    """The first ``hits`` occurrences of each needle in suffix order, with context and their place k (from 1).

    Suffixes run on into the tag of the document with the next higher uid, as in
    one flat corpus. Each document gives its own first ``hits``; each task keeps as
    many of each needle, up to HELD_BYTES together, before it hands them on; what
    comes after the last of a full list is left out from then on.
    ``key_bytes`` cuts the key (ties then go by uid and pos). A corpus that already
    has ``next``, the next higher uid of the whole, keeps it.
    """
    spark, (kind, arrow) = corpus.sparkSession, _types(needles)
    names = ["query_id", "query", "uid", "pos", "key", "before", "after"]
    shape = f"query_id {kind}, query string, uid long, pos long, key binary, before binary, after binary"
    texts = F.coalesce("text", F.lit("")).alias("text")
    follows = _spread(corpus.select("uid", texts, "next") if "next" in corpus.columns else with_next(corpus.select("uid", texts), "uid"))
    out = None
    for part in _parts(needles):
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            machine, best, worst, size = _Automaton(shared.value), {}, {}, 0
            head = min(key_bytes or FIRST_BYTES, FIRST_BYTES)

            def rows():
                held, n = [], 0
                for k, own in best.items():
                    for key, uid, p, a, z in own:
                        for i in machine.ids[machine.needles[k]]:
                            held.append((i, machine.needles[k], uid, p, key, a, z))
                            n += len(key) + 2 * width
                            if n > HELD_BYTES // 8:
                                yield batch_of(held)
                                held, n = [], 0
                if held:
                    yield batch_of(held)

            def batch_of(held):
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), [arrow, pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names)

            for batch in batches:
                for row in zip(batch.column("uid"), batch.column("text"), batch.column("next")):  # a text at a time
                    uid, text, after_uid = (x.as_py() for x in row)
                    found = machine.hits(text)
                    if not found:
                        continue
                    body = text.encode("utf-8", "surrogatepass")
                    tag = b"" if after_uid is None else b"\xff\xff" + (after_uid & 0xFFFFFFFF).to_bytes(4, "little")
                    flat = body + tag
                    for k, at in found.items():
                        n = len(machine.needles[k].encode())
                        if k in worst:
                            at = np.array([p for p in at.tolist() if flat[p : p + head] <= worst[k]], np.int64)
                        some = first_suffixes(flat, at, hits) if not key_bytes else sorted(at.tolist(), key=lambda p: (flat[p : p + key_bytes], p))[:hits]
                        own = [(flat[p : p + key_bytes] if key_bytes else flat[p:], uid, p, body[max(p - width, 0) : p], body[p + n : p + n + width]) for p in some]
                        before = best.get(k, [])
                        best[k] = heapq.nsmallest(hits, [*before, *own])
                        if len(best[k]) == hits:
                            worst[k] = min(worst.get(k, best[k][-1][0][:head]), best[k][-1][0][:head])
                        size += sum(len(x[0]) + 2 * width for x in best[k]) - sum(len(x[0]) + 2 * width for x in before)
                        if size > HELD_BYTES:  # handed on as they are: the last sort picks among them
                            yield from rows()
                            best.clear()
                            size = 0
            yield from rows()

        one = follows.select("uid", "text", "next").mapInArrow(run, shape)
        out = one if out is None else out.unionAll(one)
    if out is None:
        return spark.createDataFrame([], shape).drop("key").withColumn("k", F.lit(0).cast("long"))
    order = Window.partitionBy("query_id").orderBy("key", "uid", "pos")
    return out.withColumn("k", F.row_number().over(order).cast("long")).where(F.col("k") <= hits).drop("key")


def responses(corpus: DataFrame, needles: DataFrame, hits: int = CONTEXT_HITS, width: int = CONTEXT_BYTES) -> DataFrame:
    """(query_id, response): JSON with occurrences, before, query, after; hits in falling suffix order."""
    shown = kwic_top(corpus, needles, hits, width)
    text = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    lists = shown.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), text("before").alias("b"), text("after").alias("a")))).alias("h"))  # at most ``hits`` each
    rows = count(corpus, needles).join(lists, "query_id", "left")
    body = F.struct("occurrences", F.col("h.b").alias("before"), "query", F.col("h.a").alias("after"))
    return rows.select("query_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("response"))


def retrieve(corpus: DataFrame, needles: DataFrame, distinct: bool = False, limit: int | None = None) -> DataFrame:
    """(query_id, query, doc_id, document): a row for each occurrence, or for each document."""
    found = matches(corpus, needles)
    if not distinct:
        found = found.withColumn("n", count_overlapping(F.col("text"), F.col("query")))
        found = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    out = found.select("query_id", "query", F.col("uid").alias("doc_id"), F.col("text").alias("document"))
    if limit:
        out = out.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))).where(f"k <= {limit}").drop("k")
    return out


def contaminated(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """The items (query_id, query) that occur in the corpus."""
    return items.join(pairs(corpus, items).select("query_id").distinct(), "query_id", "left_semi")


def clean(corpus: DataFrame, items: DataFrame) -> DataFrame:
    """The items that don't occur in the corpus."""
    return items.join(pairs(corpus, items).select("query_id").distinct(), "query_id", "left_anti")


def highlight(rows: DataFrame) -> DataFrame:
    """A display line of each KWIC row: ...before<b>query</b>after..."""
    text = lambda c: F.make_valid_utf8(F.col(c).cast("string"))
    return rows.withColumn("line", F.concat(F.lit("..."), text("before"), F.lit("<b>"), "query", F.lit("</b>"), text("after"), F.lit("...")))


__all__ = ["clean", "contains", "contaminated", "count", "count_of", "document_frequency", "highlight", "hit_counts", "kwic", "kwic_top", "matches", "n_bytes", "pairs", "positions", "responses", "retrieve"]

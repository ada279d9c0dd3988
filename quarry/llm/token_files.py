"""Token ids in Arrow files of fixed-length sequences with masks.

Documents are dealt by ranges of their ids to shards, sorted, encoded and laid
end to end; each shard is an Arrow IPC file of record batches whose columns
``ids`` and ``mask`` are fixed-size lists, so that any sequence is found by
arithmetic and read from a memory map without a copy. The last sequence of a
shard is filled up with zeros under a false mask. A second file has where each
document begins. Files are written under another name and then renamed, so a
task that runs again replaces its own file; the folder is shared by all machines.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, fresh_path, partitions
from quarry.llm.piece_cache import encoder
from quarry.llm.textkernel import BATCH_BYTES, chunks

SEQUENCE, SEQUENCES_PER_BATCH = 2048, 256


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _open(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    from pyarrow import fs

    store, base = _filesystem(folder)
    if isinstance(store, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{base}/{name}"))
    return pa.ipc.open_file(store.open_input_file(f"{base}/{name}"))


class ShardWriter:
    """Writes one shard; ids of any number of documents, a batch of sequences at a time."""

    def __init__(self, folder: str, shard: int, attempt: int, width: int, wide: bool):
        self.store, self.base = _filesystem(folder)
        self.store.create_dir(self.base, recursive=True)
        self.names = [f"{kind}-{shard:06d}.arrow" for kind in ("sequences", "documents")]
        self.tmp = [f"{self.base}/.{n}.{attempt}" for n in self.names]
        self.width, self.dtype = width, np.uint32 if wide else np.uint16
        self.kind = pa.list_(pa.from_numpy_dtype(self.dtype), width)
        self.mask = pa.list_(pa.bool_(), width)
        self.out = [self.store.open_output_stream(t) for t in self.tmp]
        self.seqs = pa.ipc.new_file(self.out[0], pa.schema([("ids", self.kind), ("mask", self.mask)]))
        self.docs = pa.ipc.new_file(self.out[1], pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.held, self.n_held, self.total, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts.astype(np.int64))], ["doc_id", "start", "n_tokens"]))
        self.total += len(ids)
        self.n_docs += len(counts)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= self.width * SEQUENCES_PER_BATCH:
            self._flush(self.width * SEQUENCES_PER_BATCH)

    def _flush(self, step: int) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        full = len(flat) // step * step
        for lo in range(0, full, step):
            self._write(flat[lo : lo + step], step)
        self.held, self.n_held = [flat[full:]], len(flat) - full

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=t) for v, t in ((flat, self.kind), (mask, self.mask))]
        self.seqs.write_batch(pa.RecordBatch.from_arrays(lists, ["ids", "mask"]))

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.width) * self.width, self.dtype)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
        for w in (self.seqs, self.docs, *self.out):
            w.close()
        for tmp, name in zip(self.tmp, self.names):
            self.store.move(tmp, f"{self.base}/{name}")


class TokenFiles:
    """A written folder: any sequence, or any run of tokens of the whole corpus, by its number."""

    def __init__(self, folder: str):
        self.folder = folder
        store, base = _filesystem(folder)
        with store.open_input_stream(f"{base}/manifest.json") as f:
            self.manifest = json.loads(f.read())

    def shard(self, number: int) -> "Shard":
        return Shard(self.folder, number, self.manifest["width"])

    def tokens(self, start: int, count: int) -> np.ndarray:
        out = []
        for s in self.manifest["shards"]:
            lo, hi = max(start, s["start"]), min(start + count, s["start"] + s["n_tokens"])
            if lo < hi:
                out.append(self.shard(s["shard"]).tokens(lo - s["start"], hi - lo))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Shard:
    def __init__(self, folder: str, number: int, width: int):
        self.width = width
        self.seqs, self.docs = (_open(folder, f"{kind}-{number:06d}.arrow") for kind in ("sequences", "documents"))
        # all batches but the last ones have SEQUENCES_PER_BATCH sequences
        self.batches: dict[int, np.ndarray] = {}

    def _batch(self, i: int) -> np.ndarray:
        if i not in self.batches:
            if len(self.batches) > 8:
                self.batches.clear()
            self.batches[i] = self.seqs.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.batches[i]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of the i-th sequence."""
        at = i % SEQUENCES_PER_BATCH * self.width
        batch = self.seqs.get_batch(i // SEQUENCES_PER_BATCH)
        return self._batch(i // SEQUENCES_PER_BATCH)[at : at + self.width], batch.column(1)[i % SEQUENCES_PER_BATCH].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, count: int) -> np.ndarray:
        step, out = self.width * SEQUENCES_PER_BATCH, []
        while count:
            at = start % step
            part = self._batch(start // step)[at : at + count]
            out.append(part)
            start, count = start + len(part), count - len(part)
        return np.concatenate(out) if len(out) != 1 else out[0]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, drops_space: bool = False, width: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Encode whole texts and write them in ascending id order; returns the manifest.

    Null texts are empty and give the end id alone. Null ids come first; rows with
    equal ids follow each other by their text. An empty table gives no shards.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)

    def run(batches):
        enc, context, writer = encoder(path, drops_space), TaskContext.get(), None
        wide = enc.ids.dtype == np.uint32
        for batch in batches:
            for c in chunks(batch.column("text"), BATCH_BYTES, lower=drops_space):
                writer = writer or ShardWriter(folder, context.partitionId(), context.taskAttemptId(), width, wide)
                ids, bounds = enc.encode(c)
                counts = np.diff(bounds) + 1
                flat = np.insert(ids, bounds[1:], end_id)
                writer.add(batch.column("doc_id").slice(c.lo, c.rows), flat, counts)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([writer.n_docs], pa.int64()), pa.array([writer.total], pa.int64())], ["shard", "n_docs", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    placed = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    done = sorted(placed.mapInArrow(run, "shard int, n_docs long, n_tokens long").collect())  # a row for each shard
    start, listed = 0, []
    for r in done:
        listed.append({"shard": r["shard"], "start": start, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        start += r["n_tokens"]
    manifest = {"width": width, "end_id": end_id, "n_tokens": start, "shards": listed}
    store, base = _filesystem(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens and ids_crc32 of each document."""
    listed = manifest["shards"]
    width = manifest["width"]

    def run(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                shard = Shard(folder, listed[i]["shard"], width)
                for k in range(shard.docs.num_record_batches):
                    d = shard.docs.get_batch(k)
                    starts, counts = d.column("start").to_numpy(), d.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(shard.tokens(int(s), int(n)).astype("<u4")) for s, n in zip(starts, counts)]
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), pa.array(starts + listed[i]["start"]), d.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(listed), 1, max(1, len(listed))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    manifest = write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), 1, drops_space=True)
    return read_token_files(spark, folder, manifest)

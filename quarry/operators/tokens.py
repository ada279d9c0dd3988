"""Search for token sequences, aligned to tokens."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whitespace_tokens(corpus: DataFrame) -> DataFrame:
    """(uid, tokens): the words of each text; a tokenizer needs no more than this shape."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    return corpus.select("uid", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+")).alias("tokens"))


def tokenize_with(corpus: DataFrame, make) -> DataFrame:
    """(uid, tokens array<int>) by any function that ``make()`` returns for a worker: texts to lists of ids."""

    def run(batches: Iterable[pa.RecordBatch]):
        encode = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(encode([t or "" for t in b.column("text").to_pylist()]), pa.list_(pa.int32()))], ["uid", "tokens"])

    return corpus.select("uid", "text").mapInArrow(run, "uid long, tokens array<int>")


def token_positions(tokens: DataFrame, needle: list) -> DataFrame:
    """(uid, token_pos) of every place, from 0, at which the sequence occurs, overlaps included."""
    if not needle:
        raise ValueError("an empty needle matches everywhere")
    n = len(needle)
    want = F.array(*[F.lit(x) for x in needle])
    starts = F.when(F.size("tokens") >= n, F.sequence(F.lit(0), F.size("tokens") - n)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: (F.get("tokens", i) == F.lit(needle[0])) & (F.slice("tokens", i + 1, n) == want))
    return tokens.where(F.array_contains("tokens", F.lit(needle[0]))).select("uid", F.explode(hits).alias("i")).select("uid", F.col("i").cast("long").alias("token_pos"))


def token_count(tokens: DataFrame, needle: list) -> DataFrame:
    return token_positions(tokens, needle).agg(F.count(F.lit(1)).alias("occurrences"))

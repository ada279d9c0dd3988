"""Corpora and needles from files, and result files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import strip
from quarry.session import fresh_path

#: Text column and keys of the named tables of a folder.
NAMED = {"documents": ("text", ["doc_id"]), "pages": ("html", ["page_id"]), "conversations": ("text", ["conv_id", "turn"]), "benchmark": ("text", ["item_id"])}


def read_corpus(spark: SparkSession, path: str, kind: str = "parquet", text_key: str = "text", where: str | None = None, whole_files: bool = False, any_name: bool = False) -> DataFrame:
    """A corpus with its text column as ``text``; kind: parquet, json (*.jsonl), csv or text (*.txt).

    ``where`` selects a split or subset; with parquet it reaches the scan. With
    ``any_name`` files are read whatever they are called.
    """
    reader = lambda pattern: spark.read if any_name else spark.read.option("pathGlobFilter", pattern)
    if kind == "parquet":
        df = spark.read.parquet(path)
    elif kind == "json":
        df = reader("*.jsonl").json(path)
    elif kind == "csv":
        df = reader("*.csv").csv(path, header=True, multiLine=True, escape='"')
    elif kind == "text":
        return reader("*.txt").text(path, wholetext=whole_files).withColumnRenamed("value", "text")
    else:
        raise ValueError(f"unknown kind of corpus: {kind}")
    df = df.where(where) if where else df
    return df.withColumnRenamed(text_key, "text") if text_key != "text" else df


def named(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """(uid, text) of a named table: uid counts from 1 for documents, otherwise the first key."""
    text, keys = NAMED[table]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    uid = F.col("doc_id") + 1 if table == "documents" else F.col(keys[0])
    return df.select(uid.cast("long").alias("uid"), F.col(text).alias("text"))


def number_rows(df: DataFrame, order: list[str], name: str = "uid", start: int = 1) -> DataFrame:
    """Consecutive ids in a declared order, without one task seeing all rows.

    Range-partitioned and sorted, counted by partition, then numbered from each
    partition's base; the counts are one row for each partition. The rows are written
    once: planned again, their ranges would come from another sample and no longer fit
    the counts.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    path = fresh_path(spark, "numbered")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    counts = sorted((r["__p"], r["n"]) for r in placed.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    bases, total = {}, start
    for p, n in counts:
        bases[p], total = total, total + n
    table = spark.createDataFrame(list(bases.items()) or [(0, start)], "__p int, __base long")
    within = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(table), "__p").withColumn(name, F.col("__base") + within).drop("__p", "__i", "__base")


#: Rows of a range of ids.
RANGE_ROWS = 1 << 18


def id_ranges(df: DataFrame, by: str, least: int = 8) -> Column:
    """The number of the range that an id falls in: quantiles of the ids, as many as the rows ask for."""
    spark = df.sparkSession
    n = max(least, min(-(-df.count() // RANGE_ROWS), 1 << 14), int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    splits = sorted({int(x) for x in df.where(F.col(by).isNotNull()).select(F.col(by).cast("long").alias(by)).approxQuantile(by, [i / n for i in range(1, n)], 0.25 / n)})
    if not splits:
        return F.lit(0)
    table = F.array(*[F.lit(x) for x in splits]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splits).bit_length()))])
    # binary search: the number of splits at or below the id
    at = F.aggregate(steps, F.lit(0), lambda at, x: F.when((at + x <= len(splits)) & (F.get(table, at + x - 1) <= F.col(by)), at + x).otherwise(at))
    return F.coalesce(at, F.lit(0))


def with_next(df: DataFrame, by: str) -> DataFrame:
    """``df`` and ``next``, the next higher id (null for the last): by ranges of ids, and over the ranges' first ids."""
    placed = df.withColumn("__r", id_ranges(df, by))
    firsts = placed.groupBy("__r").agg(F.min(by).alias("first"))  # a row for each range
    later = firsts.select((F.col("__r")).alias("__r"), F.lead("first").over(Window.orderBy("__r")).alias("__later"))
    within = F.lead(by).over(Window.partitionBy("__r").orderBy(by))
    return placed.withColumn("__in", within).join(F.broadcast(later), "__r").withColumn("next", F.coalesce("__in", "__later")).drop("__r", "__in", "__later")


def needles(spark: SparkSession, queries: list[str]) -> DataFrame:
    """(query_id, query) of a list: ids are places from 0, blank entries are skipped but counted, ends stripped."""
    rows = [(i, q) for i, q in enumerate(queries)]
    df = spark.createDataFrame(rows, "query_id int, query string")
    return df.select("query_id", strip(F.col("query")).alias("query")).where("query <> ''")


def read_needles(spark: SparkSession, path: str) -> DataFrame:
    """A query file, one query a line; a query list is small and read as one file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "query"))
    return lines.select("query_id", strip(F.col("query")).alias("query")).where("query <> ''")


def decode_base64_tokens(encoded: str) -> list[int]:
    """Token ids of a base64 string of little-endian unsigned 16-bit integers."""
    import base64

    raw = base64.b64decode(encoded, validate=True)
    if len(raw) % 2:
        raise ValueError("a token query needs two bytes a token")
    return [raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]


def parse_request(body: str) -> dict:
    """A request's fields by name in any case: dataset, length, query, tokenize."""
    fields = {k.lower(): v for k, v in json.loads(body).items()}
    return {"dataset": fields.get("dataset", ""), "length": int(fields.get("length", 0)), "query": fields.get("query", ""), "tokenize": bool(fields.get("tokenize", False))}


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as CSV with a header; quotes, line breaks and blanks survive a round trip."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).csv(path)


def flat_corpus(corpus: DataFrame) -> DataFrame:
    """(uid, record): each body behind its tag, FF FF and the id as four little-endian bytes."""
    from quarry.functions import little_endian

    return corpus.select("uid", F.concat(F.lit(b"\xff\xff"), little_endian(F.col("uid"), 4), F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("record"))



"""Column expressions for byte-exact search; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(needle: Column) -> Column:
    """A needle as a literal part of a regular expression, whatever it holds."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def look_ahead(needle: Column) -> Column:
    """A pattern that matches, without width, wherever the needle starts."""
    return F.concat(F.lit("(?="), quoted(needle), F.lit(")"))


def count_overlapping(text: Column, needle: Column) -> Column:
    """Occurrences of a needle, overlaps included; null text counts 0, an empty needle gives null."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), look_ahead(needle)).cast("long")
    return F.when(needle != "", n)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a blank text."""
    bare = strip(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+"))).cast("long")


def n_bytes(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def valid_body(text: Column) -> Column:
    """A body must not hold the byte pair FF FF that marks a document in a flat corpus."""
    return ~F.contains(F.coalesce(text.cast("binary"), F.lit(b"")), F.lit(b"\xff\xff"))


def little_endian(value: Column, width: int) -> Column:
    """The lowest ``width`` bytes of an integer, lowest first, as binary."""
    parts = [F.lpad(F.hex(F.shiftright(value, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(width)]
    return F.unhex(F.concat(*parts))


def pack_tokens(ids: Column, width: int = 4) -> Column:
    """An array of token ids as little-endian binary."""
    return F.unhex(F.array_join(F.transform(ids, lambda t: F.hex(little_endian(t.cast("long"), width))), ""))


def unpack_tokens(packed: Column, width: int = 2) -> Column:
    """Token ids of little-endian binary, ``width`` bytes each; an error where bytes are left over."""
    hexed = F.hex(packed)
    n = (F.octet_length(packed) / width).cast("int")
    one = lambda i: F.conv(F.concat(*[F.substring(hexed, (i * width + b) * 2 + 1, F.lit(2)) for b in reversed(range(width))]), 16, 10).cast("long")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one)).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.octet_length(packed) % width != 0, F.raise_error(F.lit(f"a token needs {width} bytes"))).otherwise(ids)


def succ(key: bytes) -> bytes | None:
    """The smallest byte string above all that start with ``key``; None if there is none."""
    bare = key.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def common_prefix(a: Column, b: Column) -> Column:
    """Bytes that two binaries share at their start (0 where one is null)."""
    width = F.least(F.octet_length(a), F.octet_length(b))
    at = F.aggregate(
        F.sequence(F.lit(1), F.greatest(width, F.lit(1))),
        F.lit(0),
        lambda n, i: F.when((n == i - 1) & (i <= width) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(n),
    )
    return F.coalesce(at, F.lit(0)).cast("long")

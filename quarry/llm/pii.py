"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field (``pii_field``) is trained from a
small labelled table and tags every word of every text; what it finds is added
where it doesn't overlap a base span: spaced or disguised addresses, numbers in
other forms, and a fifth kind, ``secret`` (keys and tokens), behind the four of
the patterns.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents
from quarry.llm.pii_field import KINDS, Field, trained_field
from quarry.llm.textkernel import chunks

#: Bytes of text whose words are tagged at once, and rows that a worker takes up at once: both bound its memory.
CHUNK, ROWS = 512 << 10, 512
#: The kinds that the patterns find.
BASE_KINDS = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LONG_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){11}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def email_spans(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each ``@`` so that long words cost no more than their length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all pattern matches that pass their checks, by start, then kind as listed.

    An address pattern can only start where a run of digits starts: if a run's
    first digit fails, so do the others, and no match ends inside a run.
    """
    out = [(a, b, 0) for a, b in email_spans(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            out.append((m.start(), m.end(), 1))
    if _LONG_NUMBER.search(text):
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def find_spans(texts: list[str] | pa.Array, field: Field | None = None) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text; what the field adds never overlaps a base span."""
    field = field or trained_field()
    column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    out = []
    for chunk in chunks(column, CHUNK):
        extra: dict[int, list[tuple[int, int, str]]] = {}
        for row, *span in field.spans(chunk):
            extra.setdefault(row, []).append(tuple(span))
        for i, text in enumerate(pc.fill_null(column.slice(chunk.lo, chunk.rows), "").to_pylist()):
            base = base_spans(text)
            ends = np.array([b for _, b, _ in base], np.int64)
            starts = np.array([a for a, _, _ in base], np.int64)
            more = [s for s in extra.get(i, ()) if not ((starts < s[1]) & (ends > s[0])).any()]
            out.append((base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))) if more else base))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``; n_* count the base spans, ``n_added`` what the field adds.

    Null texts are empty and have no spans; repeated or null ids stay as they are;
    an empty table gives no rows; other columns are not read. Offsets count code
    points.
    """
    field = docs.sparkSession.sparkContext.broadcast(trained_field())

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                found = find_spans(part.column("text"), field.value)
                counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in BASE_KINDS]
                digest = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([_joined(a) for _, a in found], pa.string()), pa.array([len(a) - len(b) for b, a in found], pa.int64())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"])

    shape_ = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, shape_)


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replace spans by <KIND>; of overlapping spans the first, and the rest of the later one, go."""
    out, at = [], 0
    for a, b, k in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all personal data in the text replaced; null texts stay null, other columns and repeated rows as they are."""
    schema = docs.schema
    field = docs.sparkSession.sparkContext.broadcast(trained_field())

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = part.column(at).to_pylist()
                found = find_spans(part.column(at), field.value)
                new = pa.array([t if not spans else redact_text(t, spans) for t, (_, spans) in zip(texts, found)], batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([new if i == at else part.column(i) for i in range(part.num_columns)], schema=part.schema)

    return docs.mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))

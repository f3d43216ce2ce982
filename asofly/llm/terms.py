"""Terms of texts as bytes: runs of letters, digits where asked for, and all characters beyond ASCII; A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_table(digits: bool) -> bytes:
    """Translation of UTF-8 bytes: what stands in a term stays (A-Z lower-cased), all else becomes a space."""
    kept = {b: b for b in range(0x80, 0x100)} | {b: b for b in range(0x61, 0x7B)} | {b: b + 32 for b in range(0x41, 0x5B)}
    if digits:
        kept |= {b: b for b in range(0x30, 0x3A)}
    return bytes(kept.get(b, 0x20) for b in range(256))


LETTERS, WORDS = byte_table(digits=False), byte_table(digits=True)


def utf8(column: Column | str) -> Column:
    """The text's bytes, null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def terms_of(text: bytes, table: bytes) -> list[bytes]:
    return text.translate(table).split()


def strings(values: list[bytes | None]) -> pa.Array:
    """UTF-8 bytes as an Arrow string column, without decoding them one by one."""
    return pa.array(values, pa.binary()).cast(pa.string())


def rows_of(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[zip]:
    """Rows of the batches as tuples, a few at once, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from zip(*[c.to_pylist() for c in part.columns], strict=True)

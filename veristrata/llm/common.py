"""What the operators share: folds, keys and text handling.

Null texts count as empty texts everywhere, null ids belong to no training
fold, and columns beyond the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that end a word: space and \x09-\x0D, as bytes.split() has them.
SPACE = r"\x20\x09-\x0D"


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def lower_ascii(col: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def packed(docs: DataFrame, **helpers: Column) -> DataFrame:
    """`row`, a struct of all of docs' columns, beside helper columns: no helper can clash with a column of the user's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in helpers.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns again, some with a new value."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def identity(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """What tells one text of one document from another, for null-safe equi-joins: doc, no_id, text_hash."""
    return {"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), "no_id": F.col(doc_id).isNull(), "text_hash": F.xxhash64(text_of(text))}


IDENTITY = ["doc", "no_id", "text_hash"]


def words(data: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 text, split at \\x20 and \\x09-\\x0D only."""
    return data.lower().split()


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function from one RecordBatch to an iterator of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text, one row at least."""
    import numpy as np

    col = batch.column(column)
    sizes = np.zeros(len(col), dtype=np.int64)
    if len(col):
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32, count=col.offset + len(col) + 1)[col.offset :]
        sizes = np.diff(offsets).astype(np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(col):
        yield batch.slice(start)

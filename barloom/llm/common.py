"""Small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points that end a word: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Text with A-Z in lower case and every other character as it is."""
    # translate looks up every character; a text that is ASCII as a whole is in lower case just as well, and far sooner.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """Key of a text; equal for equal texts, null for null."""
    return F.md5(text.cast("binary"))


def training_row(doc_id: Column, held_out: int) -> Column:
    """False for the fifth of the documents, by the crc32 of doc_id as text, that nothing is learnt from."""
    return bucket_of(doc_id) != held_out


def bucket_of(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def free_name(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes of text each, at least one row, so that work arrays stay small."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lengths) // size
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if b > a:
                yield batch.slice(a, b - a)

"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from citelake.sources.shared import durable, forget  # noqa: F401 (operators take them from here)

#: Upper- to lower-case for A-Z alone; other letters stay as they are.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)
#: Words of letters and digits; every character outside ASCII belongs to a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words as runs without ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Python-side batches are cut to about this many characters, so that a worker's memory stays bounded.
BATCH_CHARS = 4_000_000


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col(f"`{name}`")


def packed(docs: DataFrame, added: list[str]) -> Column:
    """All columns but those named like added ones, as one struct `row`: no column of the caller's meets a name used on the way."""
    return F.struct(*(quoted(c) for c in docs.columns if c.lower() not in added)).alias("row")


def plain_names(docs: DataFrame, added: list[str]) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """For work in Python, whose schemas don't take every name: `docs` without columns named like added ones, with `text` as it is and the
    others as c0, c1, ...; those names; and what gives a result its names back and leaves others as they are."""
    keep = [c for c in docs.columns if c.lower() not in added]
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(keep)]

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *(c for c in out.columns if c not in names))

    return docs.select(*(quoted(c).alias(n) for c, n in zip(keep, names, strict=True))), names, back


def words_of(text: Column) -> Column:
    """The array of a text's words (see WORD), A-Z in lower case."""
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def tokens_of(text: Column) -> Column:
    """The array of a text's runs without ASCII white space (see TOKEN)."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def pieces(batch: pa.RecordBatch, text: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of about `limit` bytes of text, of one row at least."""
    lengths = batch.column(text).cast(pa.large_string()).fill_null("")
    import pyarrow.compute as pc

    sizes, start, total = pc.binary_length(lengths).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def row_ids() -> Iterator[int]:
    """Numbers that no other task gives; a task that runs again gives the same ones for the same rows."""
    from pyspark import TaskContext

    base, i = TaskContext.get().partitionId() << 40, 0
    while True:
        yield base | i
        i += 1

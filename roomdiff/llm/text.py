"""Helpers of the text operators: batches of bytes, cached word values, and per-batch maps over DataFrames.

Every operator here reads only the columns it is told to (``id_col``, ``text_col``), so further columns, whatever their names, cannot clash.
A null text counts as a text without words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SLICE = 512                 # documents worked on at once inside an Arrow batch, to bound a task's memory
SLICE_BYTES = 8 << 20        # bytes of text of these, where texts may be very long
CACHE = 400_000             # words whose values a task remembers


class Memo(dict):
    """Values of words, computed once; emptied when it holds ``most`` words, so a task's memory stays bounded."""

    def __init__(self, make: Callable, most: int = CACHE):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value


def hash32(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word)


def hash64(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a string column."""
    return column.cast(pa.binary()).to_pylist()


def split_words(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words between space and tab to carriage return."""
    return raw.lower().split() if raw else []


def own(df: DataFrame, name: str):
    """A column of ``df`` by its very name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def byte_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows and about ``most`` bytes of text; a longer row is a slice of its own."""
    for batch in batches:
        weight = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at = total = 0
        for k, w in enumerate(weight.tolist()):
            if k > at and (k - at >= size or total + w > most):
                yield batch.slice(at, k - at)
                at, total = k, 0
            total += w
        if at < batch.num_rows:
            yield batch.slice(at)


def per_text(df: DataFrame, make: Callable, schema: str, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and the columns of ``schema`` for each row. ``make()`` runs once in a task and gives a function from a list of
    UTF-8 texts (None for null) to the list of its Arrow columns."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        work = make()
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *work(as_bytes(part.column(1)))], names=["id", *names])

    names = [c.split()[0] for c in schema.split(", ")]
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, {schema}")
    return out.withColumnRenamed("id", id_col)


def by_place(df: DataFrame, run: Callable, like: DataFrame) -> DataFrame:
    """``df.mapInArrow(run)`` with the columns of ``like``: inside, columns are known by their places, so they may have any names."""
    schema = StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(like.schema.fields)])
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema).toDF(*like.columns)


def rewrite(df: DataFrame, make: Callable, text_col: str) -> DataFrame:
    """``df`` with all its columns; ``make()`` runs once in a task and gives a function from UTF-8 texts to (texts or None, mask or None):
    the new text column and the rows that stay."""
    at = df.columns.index(text_col)

    def run(batches):
        work = make()
        for part in slices(batches):
            texts, stay = work(as_bytes(part.column(at)))
            if texts is not None:
                part = part.set_column(at, part.schema.field(at), pa.array(texts, pa.string()).cast(part.schema.field(at).type))
            yield part if stay is None else part.filter(pa.array(stay))

    return by_place(df, run, df)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` word hashes (uint64)."""
    count = max(len(ids) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    if not count:
        return out
    for k in range(n):
        out = (out ^ ids[k:k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def long_array(values: list[np.ndarray], kind=np.int64) -> pa.Array:
    """A list column from one array per row."""
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind, copy=False)))

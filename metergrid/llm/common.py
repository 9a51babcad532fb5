"""Shared plumbing of the training-data operators: reading, checkpointed tables, Arrow maps.

Conventions that hold for every operator of this subpackage:

* A null text is read as the empty text.
* Input columns travel through untouched; where an output column has the name of an input
  column, the output replaces it.
* Rows are never dropped unless the operator is a filter; repeated rows stay repeated.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metergrid.tables import Scratch, shared_dir, written

__all__ = ["Scratch", "arrow_map", "bounded_sample", "flat_bytes", "held_out", "read", "release", "shared_dir", "sliced", "text_bytes", "whole_groups", "written"]

#: Bytes of text that one Python step holds besides the Arrow batch it came in.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release() -> None:
    """Returns to the system what Arrow and malloc keep of freed memory. Workers outlive their tasks, and else hold the most
    that any step before has taken."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def text_bytes(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte buffer and the n + 1 offsets of its rows; null is empty."""
    values = column.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    base = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if values.null_count:
        lengths = np.where(np.asarray(values.is_valid()), np.diff(offsets), 0)
        if not np.array_equal(lengths, np.diff(offsets)):
            return flat_bytes(pa.array([x or b"" for x in values.to_pylist()], pa.large_binary()))
    return base[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows so that each part has about `limit` bytes of text (one row at least)."""
    sizes = np.asarray(pc.binary_length(batch.column(text_col)).fill_null(0))
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows, which come sorted by the long column `key`, cut only between its values."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        ends = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(ends):
            yield pa.Table.from_batches([*held, batch.slice(0, ends[-1])])
            held = [batch.slice(ends[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def arrow_map(
    df: DataFrame,
    text_col: str,
    outputs: T.StructType,
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    carry: list[str] | None = None,
    limit: int = SLICE_BYTES,
    reads: tuple[str, ...] = (),
) -> DataFrame:
    """Adds `outputs` to the rows of df. `make` runs once a task and gives the function that computes the
    output arrays of one slice. `carry` names the input columns that travel along (default: all); `reads` names
    columns that the function uses besides the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in (df.columns if carry is None else carry) if c not in set(outputs.fieldNames())]
    need = list(dict.fromkeys([*names, text_col, *reads]))
    narrow = df.select(*[F.col(f"`{c}`") for c in need])
    schema = T.StructType([narrow.schema[c] for c in names] + list(outputs.fields))
    out_types = [f.type for f in to_arrow_schema(outputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in sliced(batch, text_col, limit):
                arrays = [part.column(c) for c in names]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(step(part), out_types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())
                del part, arrays
            del batch
            release()

    return narrow.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the id: the same rows wherever they are stored."""
    total = df.count()
    if total <= rows:
        return df
    share = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) < share)

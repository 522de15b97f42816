"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: By kind: a broadcast's value and what was made of it, kept for the tasks that a Python worker runs one after another.
#: Workers outlive stages and executors have two or more of them, so a worker keeps one kind at a time.
_BUILT: dict[str, tuple[object, object]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def built(kind: str, source: Broadcast, make: Callable):
    """``make(source.value)``, once for a worker; what was built before of this or another kind is let go."""
    value = source.value
    if kind not in _BUILT or _BUILT[kind][0] is not value:
        drop_built()
        _BUILT[kind] = (value, make(value))
    return _BUILT[kind][1]


def drop_built() -> None:
    """Lets go of what earlier operators built in this worker, which outlives their stages, and gives the memory back."""
    if _BUILT:
        _BUILT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text (null: empty), modulo ``modulus``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def texts(docs: DataFrame, text: str = "text") -> Column:
    """The text as bytes of UTF-8; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def words(text: bytes) -> list[bytes]:
    """Words between blanks (0x20, 0x09-0x0D) after lower-casing A-Z; other bytes stay."""
    return text.lower().split()


def hash_share(share: float, *columns: Column) -> Column:
    """True for about ``share`` of all rows, decided by a hash of the columns alone."""
    cells = 1 << 30
    return F.pmod(F.xxhash64(*columns, F.lit(7)), F.lit(cells)) < F.lit(int(min(1.0, share) * cells))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds one row or at most about ``limit`` bytes of ``column`` (bytes or lists of ints).

    What a task makes of a slice, often several times its size, is held beside the batch, in every worker of an executor.
    """
    for batch in batches:
        values = batch.column(column)
        lengths = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype("int64")
        block, at = (sizes.cumsum() // limit), 0
        while at < batch.num_rows:
            end = max(at + 1, int(block.searchsorted(block[at], side="right")))
            yield batch.slice(at, end - at)
            at = end

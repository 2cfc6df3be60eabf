"""Bytes-level words and Arrow helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from seqforge.session import ship_package

#: Lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space.
ASCII_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SPACE = b" \t\n\x0b\x0c\r"


def words(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.translate(ASCII_WORDS).split()


def chunks(text: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased."""
    return text.lower().split()


def slices_of(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at white space only."""
    begin = 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:] if begin else text


#: Rows and bytes of an Arrow batch that goes to Python. Texts may be long, so rows alone are no bound.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def byte_values(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each row, one at a time; a null counts as empty."""
    column = pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        buffer = value.as_buffer()
        yield b"" if buffer is None else buffer.to_pybytes()


def give_back() -> None:
    """Return what a task has freed to the system: a worker lives on and runs other stages' tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def arrow_column(make: Callable[[], Callable[..., pa.Array]], kind: str, *columns: Column) -> Column:
    """A function over Arrow batches of ``columns``; rows stay in their order, and other columns stay in the JVM.

    ``make`` is called once for each task and returns the function; what it remembers ends with the task."""
    ship_package(SparkSession.active())
    bound_batches(SparkSession.active())
    if len(columns) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            fn = make()
            try:
                for a in batches:
                    yield fn(a)
            finally:
                fn = None
                give_back()

        return F.arrow_udf(one, kind)(*columns)

    def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fn = make()
        try:
            for a, b in batches:
                yield fn(a, b)
        finally:
            fn = None
            give_back()

    return F.arrow_udf(two, kind)(*columns)


def struct_array(**fields: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

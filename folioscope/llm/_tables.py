"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import _hashing as hashing
from folioscope.session import cut_lineage, shuffle_width

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
EMPTY = np.zeros(0, np.uint8)

__all__ = ["DOCUMENT_COLUMNS", "EMPTY", "byte_views", "cut_lineage", "given", "held_out", "like", "release", "shuffle_width", "small_batches", "tidied"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows with whole texts are long: hand fewer of them to Python at once, unless the session has fewer set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def given(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the id, written as text, leaves ``fold``. A null id counts as ''."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def like(docs: DataFrame) -> DataFrame:
    """Only the columns of ``documents``; other columns of the input are left behind."""
    small_batches(docs.sparkSession)
    return docs.select(*DOCUMENT_COLUMNS)


def release() -> None:
    """Give memory that a finished task no longer uses back to the machine; Python workers live on between tasks."""
    hashing.forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, and ``release`` after the last."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def byte_views(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of every string of an Arrow column without copying; None for nulls."""
    if len(column) == 0:
        return
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        width = np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else EMPTY
    missing = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield None if missing is not None and missing[i] else raw[at[i] : at[i + 1]]

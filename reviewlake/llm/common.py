"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import materialize


_KEPT: list = []


def kept_in_worker(make: Callable) -> Callable:
    """``make`` with its last result kept in a Python worker from task to task, until ``forget`` is called there."""
    kept = lru_cache(1)(make)
    _KEPT.append(kept)
    return kept


def forget() -> None:
    """Called by tasks of other stages: what earlier stages kept in this worker goes, and its memory back to the system."""
    some = [kept for kept in _KEPT if kept.cache_info().currsize]
    for kept in some:
        kept.cache_clear()
    if some:
        trim()


def trim() -> None:
    """Memory that is free in this process goes back to the system; the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def trimmed(work: Callable) -> Callable:
    """``work`` on the batches of a task, with ``trim`` at its end.

    Spark keeps workers between tasks, more of them than it has cores if a task had several, and takes them in turn. So
    each would wait with the memory of its largest task, beside the memory of the JVM.
    """

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its work is done once and survives lost executors."""
    return materialize(df, f"llm-{name}")


def batches_by_size(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``most`` bytes of text in ``column``, or of one row."""
    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def id_and_text(docs: DataFrame, *, empty: bool = True) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever other columns there are; null text is empty if wished."""
    text = F.coalesce(F.col("text"), F.lit("")) if empty else F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text"))

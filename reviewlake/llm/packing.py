"""Packing: concatenate and cut, with two passes of prefix sums.

All documents, each followed by the end id, form one stream of tokens. The first pass encodes every document once,
counts it from the start of its partition, and writes both; the totals of the partitions, one row each, give the
place of every partition in the stream. In the second pass a document knows its place and is cut at the multiples of
the window on its own, without a shuffle of tokens. Only the last sequence can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import batches_by_size, forget, id_and_text, kept_in_worker, trimmed, written
from reviewlake.llm.pretokens import Recent, Splitter, load, packed_ids

WINDOW = 2048
KNOWN = 150_000  # words whose ids a worker keeps, twice at most: some 60 MB


@kept_in_worker
def _worker(path: str, end_id: int) -> tuple[type, Splitter, Recent]:
    """What a Python worker keeps from task to task."""
    tokenizer = load(path)
    kind, code = (np.uint16, "H") if tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else (np.uint32, "I")
    return kind, Splitter(tokenizer, False), Recent(packed_ids(tokenizer, code), KNOWN)


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Pass one: ids of each document as unsigned 16- or 32-bit integers, and its start in the partition."""

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        kind, split, cache = _worker(path, end_id)
        width = np.dtype(kind).itemsize
        end = np.array([end_id], kind).tobytes()
        for batch in batches_by_size(batches, 1, 1 << 20):
            words = [split(text) for text in batch.column(1).to_pylist()]
            known = cache.of(words)
            ids = [b"".join(map(known.__getitem__, ws)) + end for ws in words]
            sizes = np.array([len(x) // width for x in ids], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(sizes),
                    pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary()),
                ],
                ["doc_id", "part", "at", "doc_tokens", "width", "ids"],
            )

    return id_and_text(docs).mapInArrow(
        encode, "doc_id long, part int, at long, doc_tokens long, width int, ids binary"
    )


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``start`` counts the ids of the document before the piece, ``offset`` the ids of the sequence before it; ``ids`` are
    little-endian unsigned 32-bit. Every id lies in exactly one piece. Null text is empty: such a document is the end
    id alone. Null ids of documents are packed too, repeated rows each. An empty table gives no piece.
    """
    encoded = written(_encoded(docs, path, end_id), "packing")
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))  # one row per partition of the first pass
    placed = encoded.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("at"), "doc_tokens", "width", "ids"
    )

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what the first pass kept in this worker
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for batch in batches_by_size(batches, 4, 1 << 20):
            out: list[tuple] = []
            for doc, at, size, width, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                start = 0
                while start < size:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, size - start)
                    out.append((doc, start, length, wide[4 * start : 4 * (start + length)], size, sequence, offset))
                    start += length
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for i in range(0, len(out), 4096):
                columns = zip(*out[i : i + 4096], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return placed.mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def with_checksum(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by their checksum."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reviewlake.llm.common import table

    return with_checksum(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1))

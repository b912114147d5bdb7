"""Token counts: a map-side look-up in two tiers, without any shuffle of pre-tokens.

Tier one is a broadcast table of the token numbers of frequent pre-tokens, of at most ``FREQUENT`` entries. Tier two is a
cache in each Python worker: pre-tokens that the table lacks are encoded by the library, once per worker, and kept
while the cache has room. The count of a text is the sum over its pre-tokens.

Tier one only saves work: which words it holds has no influence on any count. It is filled from a bounded sample,
``SAMPLE_ROWS`` texts spread over the table by the hash of their id, of each the ``SAMPLE_CHARS`` characters from its
middle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import batches_by_size, id_and_text
from reviewlake.llm.pretokens import Recent, Splitter, by_library, load

FREQUENT = 30_000
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 4_000
_SCALE = 1_000_000


def frequent_lengths(docs: DataFrame, path: str) -> dict[str, int]:
    """Token numbers of the most frequent pre-tokens of a bounded sample, at most ``FREQUENT``."""
    rows = docs.count()
    share = min(_SCALE, -(-SAMPLE_ROWS * _SCALE // max(rows, 1)))
    middle = F.greatest(F.lit(1), ((F.length("text") - SAMPLE_CHARS) / 2).cast("int"))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < share).select(
        F.substring(F.col("text"), middle, F.lit(SAMPLE_CHARS)).alias("text")
    )

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Splitter(load(path), True), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
        words = counts.most_common(FREQUENT)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array([w for w, _ in words], pa.string()), "n": pa.array([n for _, n in words], pa.int64())}
        )

    totals = sample.coalesce(16).mapInArrow(tops, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [r.word for r in totals.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    encoded = load(path).encode_batch_fast(words, add_special_tokens=False)
    return {w: len(e.ids) for w, e in zip(words, encoded, strict=True)}


@lru_cache(2)
def _worker(path: str) -> tuple[Splitter, Recent]:
    """What a Python worker keeps from task to task."""
    tokenizer = load(path)
    return Splitter(tokenizer, True), Recent(by_library(tokenizer, len))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, without begin, end or added special tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not looked at. Null text counts as empty (0 bytes, 0
    tokens), a null ``doc_id`` stays null, repeated rows give a row each. Special strings inside a text are one token,
    as the library takes them by default. ``over_limit``: more than ``limit`` tokens.
    """
    spark = docs.sparkSession
    texts = id_and_text(docs)
    frequent = spark.sparkContext.broadcast(frequent_lengths(texts, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, (split, cache) = frequent.value, _worker(path)
        for batch in batches_by_size(batches, 1):
            words = [split(text) for text in batch.column(1).to_pylist()]
            second = cache.of(words, first)

            def length(word, get=first.get, second=second):
                n = get(word)
                return second[word] if n is None else n

            numbers = [sum(map(length, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(numbers, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    sized = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reviewlake.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

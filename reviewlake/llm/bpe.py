"""BPE encoding and decoding: last tokens handed down a trie of the distinct words.

For byte pair encoding, the encoding of a byte string without its last token is the encoding of the shorter string.
So the whole encoding of a word is known from the *last token* of each of its prefixes. The distinct pre-tokens form
a trie; a depth-first walk gives each node its last token: of the vocabulary entries that end at the node, the one that
the merge order leaves standing beside the last token of the node where it begins. A prefix that many words share is
worked out once. The walk meets the words in byte order, so that the trie is held as the sorted words, and of the
states only those on the path from the root.

Whether two neighbouring tokens stay apart depends on these two alone, and is kept per pair.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm.common import batches_by_size, id_and_text
from reviewlake.llm.pretokens import Recent, Splitter, load


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, and the rank and result of each merge, from a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = _bytes_of_letters()
        model = content["model"]
        self.token = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.token.items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in t) for t in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[self.token[a], self.token[b]] = (n, self.token[a + b])
        self.longest = max(map(len, self.token))
        self.packed = {i: struct.pack("<I", i) for i in self.bytes_of}
        self._whole: dict[int, bool] = {}
        self._apart: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Plain merging by rank, used for pairs of tokens."""
        ids, rank = [self.token[data[i : i + 1]] for i in range(len(data))], self.rank
        while len(ids) > 1:
            best = min(((rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i : i + 2] = [new]
        return ids

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as this token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens together are encoded as these two."""
        key = left << 32 | right
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > 600_000:
                self._apart.clear()
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._apart[key] = known
        return known


class Trie:
    """Encodings of words by a depth-first walk of the trie that they form."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        v = self.vocabulary
        token, longest, whole, apart = v.token, v.longest, v.whole, v.apart
        found: dict[bytes, bytes] = {}
        before, last, ids = b"", [-1], [b""]  # last tokens and encodings of all prefixes on the path
        for data in sorted({w.encode() for w in words}):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    t = token.get(data[start:end])
                    if t is not None and whole(t) and (not start or apart(last[start], t)):
                        last.append(t)
                        ids.append(ids[start] + v.packed[t])
                        break
            found[data] = ids[-1]
            before = data
        return [found[w.encode()] for w in words]


class Codec:
    """Encodes whole texts through the trie, and decodes ids."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = Splitter(load(path), False)
        self.words = Recent(Trie(self.vocabulary).encoded)
        self.fixed = {s: struct.pack("<I", i) for s, i in self.vocabulary.special.items()}
        size = max(self.vocabulary.bytes_of) + 1
        self.tokens = [self.vocabulary.bytes_of.get(i, b"") for i in range(size)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        known = self.words.of(words, self.fixed)
        known.update(self.fixed)
        return [b"".join(map(known.__getitem__, ws)) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; bytes that are no UTF-8 become replacement characters."""
        data = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode(errors="replace").encode()


@lru_cache(2)
def codec(path: str) -> Codec:
    """What a Python worker keeps from task to task."""
    return Codec(path)


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``ids`` (binary, little-endian unsigned 32-bit) of every whole text, special strings included.

    Null text is empty and has no ids; null ids of documents stay null, repeated rows give a row each; other columns
    are not looked at.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches_by_size(batches, 1):
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(encode, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` for rows of ``doc_id`` and ``ids`` as of ``encode_texts``; null ids give null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches_by_size(batches, 1):
            texts = [None if ids is None else own.decode(ids).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of the ids of every text, and the digest of the text decoded from these ids.

    One pass over the texts; what a worker has learnt of words serves both ways.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches_by_size(batches, 1):
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(
        digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reviewlake.llm.common import table

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Token operators against the libraries, by brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlake.llm import bpe, packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "It's a test ’quoted’ 'S 've x\x1cq\x85z  \n\n tail  ", "中文字符，日本語テキスト 한국어 ٣٤ ½ ²", "<|endoftext|>a<|startoftext|> b<|endoftext|>",
    "ΑΣ ΟΔΟΣ İstanbul éä ﬁ ǅ", "🙂👍🏽 x‍y﻿", "'''ss 'sss ''s", "a" * 50_000, "word " * 20_000, "\x00\x01 ab", " " * 50 + "x",
    "don't WE'LL I'D 1234 12ab34 _-=+ ¿Qué? ñÑ çÇ ß ſ ŉ ǆ", "same", "same",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(13, "same", "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)


def test_counts(spark, docs):
    library = Tokenizer.from_file(WORDS)
    expected = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    found = tokens.count_tokens(docs, WORDS, limit=3).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == expected
    assert all(r.over_limit == (r.n_tokens > 3) for r in found)
    assert tokens.count_tokens(docs.where("false"), WORDS).count() == 0


def test_round_trip(spark, docs):
    library = Tokenizer.from_file(BYTES)
    expected = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((str(r.doc_id), len(ids), digest, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip_digests(docs, BYTES).collect()) == sorted(expected)
    assert bpe.round_trip_digests(docs.where("false"), BYTES).count() == 0
    encoded = bpe.encode_texts(docs, BYTES)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode_ids(encoded, BYTES).collect())
    assert back == sorted((str(r.doc_id), r.text or "") for r in docs.collect())


def test_trie_agrees_with_plain_merging():
    vocabulary = bpe.Vocabulary(BYTES)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abtheing é"), rng.integers(1, 14))) for _ in range(500)]
    for word, ids in zip(words, bpe.Trie(vocabulary).encoded(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == vocabulary.merged(word.encode())


def test_decoding_of_broken_bytes():
    codec = bpe.Codec(BYTES)
    ids = np.array([codec.vocabulary.token[b"\xc3"]], "<u4").tobytes()
    assert codec.decode(ids).decode() == "�"


def test_packing(spark, docs):
    library = Tokenizer.from_file(BYTES)
    stream = {}
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        stream[r.doc_id] = library.encode(r.text or "", add_special_tokens=False).ids + [1]
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.with_checksum(packing.pack(own, BYTES, 1, window=64)).collect()
    covered, filled = {}, {}
    for p in pieces:
        ids = stream[p.doc_id]
        assert p.doc_tokens == len(ids) and 0 < p.length <= 64
        assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for whole, parts in [(len(stream[d]), v) for d, v in covered.items()] + [(64 if s < max(filled) else None, v) for s, v in filled.items()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert whole is None or at == whole
    assert covered.keys() == stream.keys()
    assert packing.pack(docs.where("false"), BYTES, 1).count() == 0
    assert packing.pack(docs, BYTES, 1).where("doc_id = 13").count() == 2


def test_ids_by_ranks_are_the_library_s():
    from reviewlake.llm import pretokens

    library = pretokens.load(BYTES)
    split = pretokens.Splitter(library, False)
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnopqrstuvwxyzäöüßéèçñ  ABC0123456789.,!?-'\"()%$#&*中🙂\t\n")
    words = sorted({w for _ in range(20_000) for w in split("".join(rng.choice(letters, rng.integers(1, 30))))}) + ["<|endoftext|>", "a" * 20_000]
    plain = pretokens.by_library(library, lambda ids: np.array(ids, np.uint16).tobytes())(words[:-2])
    packed = pretokens.packed_ids(library, "H")
    assert packed.__module__ == "reviewlake.llm.pretokens" and packed(words[:-2]) == plain
    assert np.frombuffer(packed(words[-2:-1])[0], "<u2").tolist() == [50256]
    other = pretokens.load(WORDS)  # words that end in a mark: encoded by the library
    assert pretokens.packed_ids(other, "H")(["hello"]) == [np.array(other.encode("hello", add_special_tokens=False).ids, np.uint16).tobytes()]

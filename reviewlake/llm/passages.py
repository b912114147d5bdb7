"""Substring near-duplicates by compact windows over min-hashes of word shingles.

* A text is a row of shingles (``K`` words). For each of ``HASHES`` hash functions, the Cartesian tree over the hashes of the
  shingles has at each node the least hash of a stretch: all subsequences of at least ``LEAST`` shingles inside the stretch
  that hold the node have the same min-hash. Only nodes whose stretch is at least that long matter: every run of
  ``LEAST`` shingles has one. A node with its stretch is a *compact window*, kept with how far it reaches to both sides
  (up to ``LEAST``; longer passages have further windows).
* Windows are grouped by the min-hash and the words beside it, to the left or to the right; of any passage that two
  texts share word by word, one of the two sides lies inside. Short common lines do not get that far. Each member of a
  group is paired with the first one, whatever the two stretches have in common.
* Places at which ``ENOUGH`` hash functions agree nearby, with whatever texts, are verified: the words around the window
  are aligned with gaps allowed, and the aligned part counts if it has ``WORDS`` words or more and its shingles a Jaccard
  similarity of 0.8 or more. Where a pair fails, all members of its window are grouped by each run of ``WORDS`` words around
  it, so that word-by-word repeats are found also if the first member of the group is not among them.
* The first member may hold only a frequent notice, or a variant of the passage below 0.8. So all members that differ
  from it around the window are keyed anew, by pairs of runs of ``RUN`` words: a run that is the least of its neighbourhood,
  and the least one of those that begin ``NEAR`` to ``FAR`` words behind it. Two texts meet under such a key only if they have
  ``NEAR + RUN`` words or more in common in this way, with or without a change between the two runs, so that shorter notices bring
  nothing together. Again each member of a key is paired with the first one and verified, once.

A group of windows holds at most a few rows for each document, and is read once in order; nothing is collected for it. The
number of passes does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import batches_by_size, forget, trimmed, written
from reviewlake.llm.order_minhash import WordHashes, mixed

K = 5
WORDS = 50
LEAST = WORDS - K + 1
HASHES = 3
ENOUGH = 2
BESIDE = 12
SIMILARITY = 0.8
RUN = 8
NEAR, FAR = 18, 36
_BLOCK = 64  # the first and the last window of each block are verified; windows stand at most LEAST apart
_AROUND = WORDS - 2
_GAP = 4
_ODD = (np.random.default_rng(9).integers(0, 2**63, HASHES, np.uint64) << np.uint64(1)) | np.uint64(1)


def _doubling(x: np.ndarray, length: int, of) -> list[np.ndarray]:
    """``of`` over runs of 1, 2, 4 ... elements from each place; runs that pass the end keep what is there."""
    levels = [x]
    while 2 ** len(levels) <= length:
        half = 2 ** (len(levels) - 1)
        last = levels[-1].copy()
        last[:-half] = of(last[:-half], levels[-1][half:])
        levels.append(last)
    return levels


def _over(levels: list[np.ndarray], length: int, of) -> np.ndarray:
    """``of`` over ``length`` elements from each place."""
    level = length.bit_length() - 1
    x, shift = levels[level], length - 2**level
    out = x.copy()
    if shift:
        out[:-shift] = of(x[:-shift], x[shift:])
    return out


def compact_windows(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Of texts given by their word hashes: ``key, text, at, left, right, hash`` of all windows, as columns.

    ``at`` is the shingle of the least hash, ``left`` and ``right`` how far the window reaches, at most ``LEAST - 1``.
    """
    long = [i for i, w in enumerate(texts) if len(w) >= WORDS]
    if not long:
        return [np.empty(0, np.int64)] * 6
    sizes = np.array([len(texts[i]) for i in long])
    words = np.concatenate([texts[i] for i in long])
    shingles = np.zeros(len(words), np.uint64)
    for j in range(K):
        shingles[: len(words) - K + 1] *= np.uint64(0x9E3779B97F4A7C15)
        shingles[: len(words) - K + 1] += words[j : len(words) - K + 1 + j]
    shingles = mixed(shingles)
    ends = np.cumsum(sizes)
    inside = np.ones(len(words), bool)
    for j in range(1, K):
        inside[ends - j] = False  # between two texts stand K - 1 places without a shingle
    owner, begin = np.repeat(np.arange(len(long)), sizes), np.repeat(ends - sizes, sizes)
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for h in range(HASHES):
        v = np.where(inside, np.maximum(shingles * _ODD[h], np.uint64(1)), np.uint64(0))
        least = _doubling(v, LEAST, np.minimum)
        windows = _over(least, LEAST, np.minimum)
        windows[len(v) - LEAST + 1 :] = 0
        # the largest of the minima of all runs that hold a place: its own hash if it is the least of one of them
        back = _over(_doubling(windows[::-1].copy(), LEAST, np.maximum), LEAST, np.maximum)[::-1]
        at = np.flatnonzero((v == back) & inside)
        reach = []
        for side in (-1, 1):
            far = np.zeros(len(at), np.int64)
            for level in range(len(least) - 1, -1, -1):
                step = 1 << level
                for _ in range(1 + (level == len(least) - 1)):
                    first = at - far - step if side < 0 else at + far + 1
                    ok = (far + step < LEAST) & (first >= 0) & (first + step <= len(v))
                    low = least[level][np.clip(first, 0, len(v) - 1)]
                    far += step * (ok & (low >= v[at] if side > 0 else ok & (low > v[at])))
            reach.append(far)
        for side, far in zip((-1, 1), reach, strict=True):
            some = np.flatnonzero(far >= BESIDE)
            key = np.full(len(some), np.uint64(2 * h + (side > 0)), np.uint64)
            for step in range(0, BESIDE + 1, K - 1):
                key = mixed(key + shingles[at[some] + side * step])
            for c, x in zip(columns, (key.view(np.int64), owner[at[some]], (at - begin[at])[some], reach[0][some], reach[1][some], np.full(len(some), h)), strict=True):
                c.append(x)
    out = [np.concatenate(c) for c in columns]
    # where words repeat over and over, one of the equal windows of each block is enough
    own = mixed(out[0].view(np.uint64) + mixed((out[1] << 32 | out[2] // _BLOCK).astype(np.uint64)))
    first = np.sort(np.unique(own, return_index=True)[1])
    out = [c[first] for c in out]
    out[1] = np.array(long)[out[1]]
    return out


def _windows(docs: DataFrame) -> DataFrame:
    @trimmed
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        for batch in batches_by_size(batches, 1, 2 << 20):
            key, text, *rest = compact_windows([hashes(t.split()) for t in batch.column(1).to_pylist()])
            ids = batch.column(0).take(pa.array(text, pa.int64()))
            names = ["key", "doc", "at", "left", "right", "hash"]
            yield pa.RecordBatch.from_arrays([pa.array(key), ids, *(pa.array(x.astype(np.int32)) for x in rest)], names)

    return docs.mapInArrow(found, "key long, doc long, at int, left int, right int, hash int")


def _slices(asked: DataFrame) -> DataFrame:
    """The words around each asked place (``doc_id, text, places``): ``doc, at, begin, words`` (16-bit word hashes)."""

    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches_by_size(batches, 1):
            doc, at, begin, words = [], [], [], []
            for i, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = (hashes(text.split()) >> np.uint64(48)).astype("<u2")
                for c in places:
                    b = max(0, c - _AROUND)
                    doc.append(i)
                    at.append(c)
                    begin.append(b)
                    words.append(own[b : c + K + _AROUND].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(begin, pa.int32()), pa.array(words, pa.binary())],
                ["doc", "at", "begin", "words"],
            )

    return asked.select("doc_id", "text", "places").mapInArrow(cut, "doc long, at int, begin int, words binary")


# how many words to pass over in both texts behind an equal run: few first, and as many in one as in the other if possible
_STEPS = [
    (x, total - x)
    for total in range(1, 2 * _GAP + 1)
    for x in sorted(range(max(0, total - _GAP), min(_GAP, total) + 1), key=lambda x: abs(2 * x - total))  # noqa: B023
]


def _extended(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """Equal runs (place in a, in b, length) from the start of both on, over gaps of up to ``_GAP`` words (16-bit hashes)."""
    i = j = 0
    size_a, size_b = len(a), len(b)
    bytes_a, bytes_b = a.tobytes(), b.tobytes()  # three words are compared as six bytes
    runs = []
    while True:
        n = min(size_a - i, size_b - j)
        differ = a[i : i + n] != b[j : j + n]
        length = int(differ.argmax()) if n else 0
        if n and not differ[length]:
            length = n
        runs.append((i, j, length))
        i, j = i + length, j + length
        for x, y in _STEPS:
            p, q = i + x, j + y
            if p + 3 <= size_a and q + 3 <= size_b and bytes_a[2 * p : 2 * p + 6] == bytes_b[2 * q : 2 * q + 6]:
                i, j = p, q
                break
        else:
            return runs


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = ({w[i : i + K].tobytes() for i in range(len(w) - K + 1)} for w in (a, b))
    return len(x & y) / max(1, len(x | y))


def aligned(a: np.ndarray, ia: int, b: np.ndarray, ib: int) -> tuple[int, int] | None:
    """The part of ``b`` around ``ib`` that repeats the part of ``a`` around ``ia``: begin and end in ``b``, or None."""
    after = [(ia + i, ib + j, n) for i, j, n in _extended(a[ia:], b[ib:])]
    before = [(ia - i - n, ib - j - n, n) for i, j, n in _extended(a[:ia][::-1], b[:ib][::-1])]
    runs = [r for r in before[::-1] if r[2]] + [r for r in after if r[2]]
    while runs:
        (p, q, _), (x, y, n) = runs[0], runs[-1]
        if min(x + n - p, y + n - q) < WORDS:
            return None
        if len(runs) == 1 or _jaccard(a[p : x + n], b[q : y + n]) >= SIMILARITY:
            return q, y + n
        runs = runs[1:] if runs[0][2] < runs[-1][2] else runs[:-1]
    return None


def _verify():
    """The repeated stretch of the second slice, and whether all of it stands in the first one."""

    @F.pandas_udf("start int, stop int, same boolean")
    @trimmed
    def verify(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for parts_of in parts:
            out = []
            for wa, ba, ca, wb, bb, cb in zip(*parts_of, strict=True):
                low, high = min(ca - ba, cb - bb), min(len(wa) // 2 - ca + ba, len(wb) // 2 - cb + bb)
                ia, ib = ca - ba - low, cb - bb - low
                if low + high >= WORDS and wa[2 * ia : 2 * (ia + low + high)] == wb[2 * ib : 2 * (ib + low + high)]:
                    out.append((bb + ib, bb + ib + low + high, 2 * (low + high) == len(wb)))
                    continue
                span = aligned(np.frombuffer(wa, "<u2"), ca - ba, np.frombuffer(wb, "<u2"), cb - bb)
                out.append((span[0] + bb, span[1] + bb, False) if span else (-1, -1, False))
            yield pd.DataFrame(out, columns=["start", "stop", "same"])

    return verify


def _other_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash`` of the texts of ids that have several, but for the least text, which stands for the document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids.select("doc_id"), "doc_id", "left_semi")
    least = rows.where("text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("least"))
    return rows.join(least, "doc_id").where("text <> least").select("doc_id", F.xxhash64("text").alias("text_hash")).distinct()


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, end_word, source_id``: the stretches of each text that repeat an earlier document.

    Words are what white space parts; ``end_word`` is not in the stretch any more. ``source_id``, smaller than ``doc_id``, is
    the least document that a part of the stretch was found in. Null and short texts have none; rows without an id take
    no part; rows of one id are one document, and the least of their texts counts. Other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    others = written(_other_texts(docs), "passage-other-texts")
    if not others.isEmpty():
        own = own.withColumn("text_hash", F.xxhash64("text")).join(others, ["doc_id", "text_hash"], "left_anti").drop("text_hash")
    group = Window.partitionBy("key")
    first = F.min(F.struct("doc", "at")).over(group)
    # of the first text itself further places only: they are not compared with it, but with what comes later
    edges = _windows(own).withColumn("lead", first).withColumn("last", F.max("doc").over(group)).where(
        (F.col("lead.doc") != F.col("last")) & ((F.col("lead.doc") != F.col("doc")) | (F.col("lead.at") != F.col("at")))
    ).select(
        F.col("lead.doc").alias("a"), F.col("lead.at").alias("ca"), F.col("doc").alias("b"), F.col("at").alias("cb"),
        F.floor(F.col("at") / _BLOCK).alias("block"), "hash",
    )
    beside = Window.partitionBy("b").orderBy("block").rangeBetween(-1, 1)
    agreed = edges.withColumn("hashes", F.bit_or(F.expr("shiftleft(1, hash)")).over(beside))
    anchors = written(
        agreed.where(F.bit_count("hashes") >= ENOUGH).groupBy("a", "b", (F.col("ca") - F.col("cb")).alias("shift"), "block")
        .agg(F.array_distinct(F.array(F.min("cb"), F.max("cb"))).alias("ends")).select("a", "b", "shift", F.explode("ends").alias("cb"))
        .select("a", (F.col("cb") + F.col("shift")).alias("ca"), "b", "cb"),
        "passage-anchors",
    )
    asked = anchors.select(F.col("a").alias("doc"), F.col("ca").alias("at")).union(anchors.select("b", "cb"))
    places = asked.groupBy("doc").agg(F.collect_set("at").alias("places"))
    texts = own.join(places, own["doc_id"] == places["doc"])
    slices = written(_slices(texts).dropDuplicates(["doc", "at"]), "passage-slices")

    of_a = slices.select(F.col("doc").alias("a"), F.col("at").alias("ca"), F.col("begin").alias("ba"), F.col("words").alias("wa"))
    of_b = slices.select(F.col("doc").alias("b"), F.col("at").alias("cb"), F.col("begin").alias("bb"), F.col("words").alias("wb"))
    both = anchors.where("a <> b").join(of_a, ["a", "ca"]).join(of_b, ["b", "cb"])
    checked = written(
        both.select("a", "ca", "b", "cb", _verify()("wa", "ba", "ca", "wb", "bb", "cb").alias("span")).select("a", "ca", "b", "cb", "span.*"),
        "passage-spans",
    )
    spans = checked.where("start >= 0").select(F.col("b").alias("doc"), "start", "stop", F.col("a").alias("source"))
    failed = checked.where("start < 0").select("a", "ca").distinct()
    if not failed.isEmpty():
        # members all of whose words stand in the first one too share nothing that it does not
        others = checked.where(~F.col("same")).join(failed, ["a", "ca"], "left_semi")
        spans = spans.union(_by_runs(others, slices))
    own_places = anchors.where("a = b").select(F.col("b").alias("doc"), F.col("cb").alias("at"), F.lit(False).alias("open"))
    members = checked.where(~F.col("same")).select(F.col("b").alias("doc"), F.col("cb").alias("at"), (F.col("start") < 0).alias("open"))
    spans = spans.union(_among(members.union(own_places), slices))

    # stretches that touch become one
    row = Window.partitionBy("doc").orderBy("start", "stop")
    ahead = F.max("stop").over(row.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.coalesce((F.col("start") > ahead).cast("int"), F.lit(1)))
    islands = apart.withColumn("island", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc", "island").agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("source").alias("source_id"))
    return merged.select(F.col("doc").alias("doc_id"), "start_word", "end_word", "source_id")


def _by_runs(members: DataFrame, slices: DataFrame) -> DataFrame:
    """Word-by-word repeats among all members of the windows, by each run of ``WORDS`` words around them."""
    asked = members.select(F.col("b").alias("doc"), F.col("cb").alias("at")).distinct()

    @trimmed
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, run = [], [], []
            for i, c, b, words in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for first in range(max(0, c - b + K - WORDS), min(c - b, len(words) // 2 - WORDS) + 1):
                    doc.append(i)
                    start.append(b + first)
                    run.append(xxhash.xxh3_64_intdigest(words[2 * first : 2 * (first + WORDS)]) - 2**63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(run, pa.int64())], ["doc", "start", "run"]
            )

    around = slices.join(asked, ["doc", "at"], "left_semi").select("doc", "at", "begin", "words")
    found = around.mapInArrow(runs, "doc long, start int, run long").distinct()
    first = found.groupBy("run").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source <> last")
    return found.join(first.select("run", "source"), "run").where("doc <> source").select(
        "doc", "start", (F.col("start") + WORDS).cast("int").alias("stop"), "source"
    )


def _hashed(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(out)


def run_pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of pairs of runs: a run that is the least of ``RUN`` runs in a row, with the least one ``NEAR`` to ``FAR`` behind it."""
    hashes = _hashed(words, RUN)
    if len(hashes) <= FAR:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(hashes, RUN)
    places = np.unique(rows.argmin(axis=1) + np.arange(len(rows)))
    places = places[places + FAR < len(hashes)]
    behind = np.lib.stride_tricks.sliding_window_view(hashes, FAR - NEAR + 1)[places + NEAR].min(axis=1)
    return mixed(hashes[places] * np.uint64(0x9E3779B97F4A7C15) + behind), places


def _among(members: DataFrame, slices: DataFrame) -> DataFrame:
    """Near copies among the members (``doc, at, open``): ``doc, start, stop, source`` of the open ones."""

    @trimmed
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row, place = [], [], []
            for i, (begin, words) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own, places = run_pairs(np.frombuffer(words, "<u2").astype(np.uint64))
                key.append(own)
                place.append(places + begin)
                row.append(np.full(len(own), i))
            if row:
                of = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(key).view(np.int64)), batch.column(0).take(of), batch.column(1).take(of),
                     pa.array(np.concatenate(place).astype(np.int32)), batch.column(4).take(of)],
                    ["key", "doc", "at", "place", "open"],
                )

    asked = members.groupBy("doc", "at").agg(F.max("open").alias("open"))
    around = slices.join(asked, ["doc", "at"]).select("doc", "at", "begin", "words", "open")
    rows = around.mapInArrow(keys, "key long, doc long, at int, place int, open boolean")
    # of a pair that several slices of a text hold, the slice that has it most in the middle
    rows = written(
        rows.groupBy("key", "doc", "place").agg(F.min_by("at", F.abs(F.col("at") - F.col("place"))).alias("at"), F.max("open").alias("open")),
        "passage-pairs",
    )
    first = rows.groupBy("key").agg(F.min(F.struct("doc", "at", "place")).alias("lead"), F.max("doc").alias("last"), F.max("open").alias("any"))
    met = rows.where("open").join(first.where("any AND lead.doc < last").select("key", "lead"), "key").where("lead.doc < doc")
    # pairs of one stretch, at one shift, are one
    pairs = met.groupBy(
        F.col("lead.doc").alias("a"), F.col("doc").alias("b"), (F.col("lead.place") - F.col("place")).alias("shift"), F.floor(F.col("place") / _BLOCK).alias("block")
    ).agg(F.min(F.struct(F.col("place").alias("cb"), F.col("lead.at").alias("aa"), F.col("at").alias("ab"), F.col("lead.place").alias("ca"))).alias("p"))
    of_a = slices.select(F.col("doc").alias("a"), F.col("at").alias("aa"), F.col("begin").alias("ba"), F.col("words").alias("wa"))
    of_b = slices.select(F.col("doc").alias("b"), F.col("at").alias("ab"), F.col("begin").alias("bb"), F.col("words").alias("wb"))
    both = pairs.select("a", "b", "p.*").join(of_a, ["a", "aa"]).join(of_b, ["b", "ab"])
    checked = both.select("a", "b", _verify()("wa", "ba", "ca", "wb", "bb", "cb").alias("span")).where("span.start >= 0")
    return checked.select(F.col("b").alias("doc"), "span.start", "span.stop", F.col("a").alias("source"))


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that repeat an earlier document; ``n_chars``, if there, is counted anew.

    Documents of which no word is left go; those without a repeated passage stay as they are, as do rows with another text than the
    one that stands for their id.
    """
    cuts = repeated_passages(docs).groupBy(F.col("doc_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans")
    )

    @F.pandas_udf("string")
    @trimmed
    def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import re

        word = re.compile(r"\S+")
        for texts, cuts in parts:
            out = []
            for text, spans_of in zip(texts, cuts, strict=True):
                if spans_of is None or text is None:
                    out.append(text)
                    continue
                at = [m.span() for m in _words_of(text, word)]
                kept, done = [], 0
                for s in spans_of:
                    kept.append(text[done : at[s["start_word"]][0]])
                    done = at[s["end_word"]][0] if s["end_word"] < len(at) else len(text)
                out.append("".join([*kept, text[done:]]))
            yield pd.Series(out, dtype=object)

    # the columns of docs stay inside a struct, so that no name of theirs meets one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = rows.join(cuts, F.col("row.doc_id").cast("long") == F.col("id"), "left")
    others = _other_texts(docs).select(F.col("doc_id").alias("other_id"), "text_hash", F.lit(True).alias("other"))
    found = found.join(others, (F.col("id") == F.col("other_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("text_hash")), "left")
    is_cut = F.col("spans").isNotNull() & F.col("other").isNull() & F.col("row.text").isNotNull()
    cut = found.select("row", is_cut.alias("is_cut"), F.when(is_cut, without("row.text", "spans")).otherwise(F.col("row.text")).alias("new"))
    cut = cut.where(~F.col("is_cut") | F.col("new").rlike(r"\S"))
    changed = {"text": F.col("new"), "n_chars": F.when(F.col("is_cut"), F.length("new").cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("new")}
    return cut.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _words_of(text: str, word):
    """The words of ``str.split`` with their places."""
    return word.finditer(text)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    return repeated_passages(table(spark, sf_dir, "documents"))

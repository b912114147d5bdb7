"""Order MinHash near-duplicates: candidates by ordered minima of occurrence-labelled word 5-mers, verified by alignment.

* A text is its words; its k-mers are runs of ``K`` words, each labelled with how often it occurred before. Each of
  ``SKETCHES`` hash functions takes the ``ORDERED`` least k-mers, and keeps them in text order: two texts agree in such a
  tuple only if they hold the same k-mers in the same order, which makes it sensitive to the edit similarity.
* Texts that agree in a tuple share a bucket. Each text is compared with the least of all its partners; large groups of
  copies fall into one class by this alone. Buckets that hold several classes after it are put in order, at any size in the
  same way: by the tuples of the next ``DEPTH`` hash functions, then by length. A member is compared with the least member of
  its bucket, with the first of each run that agrees with it in the next tuples too, and with the latest ``WINDOW`` other
  classes before it. The words of the rows come along, so that pairs are verified where they meet and only links are
  written. Order and window go over the borders of partitions, so that no bucket has to fit one task.
* What order and window pass over is then compared in full: of every bucket that still holds several classes, all pairs of
  texts of different classes. Buckets are cut into blocks of ``BLOCK`` texts, two blocks meet in one task. The lengths and
  the counts of words in ``SHAPE`` classes by hash give a bound on the edits from below; pairs within it are verified
  there and then, in the first bucket they share, and only links are written. So every two texts of a bucket are of one class, or too different.
* Pairs are verified by a banded alignment of words: similarity is 1 - edits / words of the longer text. The
  band is the edits still allowed, its diagonals run along equal stretches, and work ends at the threshold.

Exact copies are one text from the start. Classes are the connected components of verified pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import batches_by_size, forget, trimmed, written
from reviewlake.llm.components import components, joined_components

K = 5
ORDERED = 2
SKETCHES = 32
DEPTH = 8
WINDOW = 8
BLOCK = 256
SHAPE = 256
SIMILARITY = 0.8
_BLOCK_WORDS = 2 << 20
_LEAST_WORDS = K + ORDERED - 1
_ODD = (np.random.default_rng(5).integers(0, 2**63, SKETCHES, np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing function on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHashes:
    """64-bit hashes of words; what is known is emptied when it is full."""

    def __init__(self, most: int = 200_000):
        self.known, self.most = _Hashes(), most

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def sketches(texts: list[np.ndarray]) -> np.ndarray:
    """``SKETCHES`` hashes of ordered minima for each text (word hashes, none empty): (texts, SKETCHES)."""
    padded = [
        np.concatenate([w, np.arange(1, _LEAST_WORDS - len(w) + 1, dtype=np.uint64)]) if len(w) < _LEAST_WORDS else w for w in texts
    ]
    sizes = np.array([len(w) for w in padded])
    words = np.concatenate(padded)
    kmers = words[: len(words) - K + 1].copy()
    for j in range(1, K):
        kmers *= np.uint64(0x9E3779B97F4A7C15)
        kmers += words[j : len(words) - K + 1 + j]
    kmers = mixed(kmers)
    ends = np.cumsum(sizes)
    counts = sizes - K + 1
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    kmers = kmers[np.arange(len(owner)) - starts[owner] + (ends - sizes)[owner]]
    labelled = mixed(kmers + mixed(_occurrences(kmers + mixed(owner.astype(np.uint64)))))
    # The ORDERED least of n even hashes are nearly always among those below 16 / n of the range.
    share = np.minimum(16 / counts, 1)
    bound = np.repeat((share * (2**64 - 2048)).astype(np.uint64) + np.where(share == 1, np.uint64(2047), np.uint64(0)), counts)
    out = np.empty((len(texts), SKETCHES), np.uint64)
    for t in range(SKETCHES):
        v = labelled * _ODD[t]
        near = np.flatnonzero(v <= bound)
        near = near[np.lexsort((v[near], owner[near]))]
        many = np.bincount(owner[near], minlength=len(texts))
        first = np.cumsum(many) - many
        at = near[np.minimum(first[:, None] + np.arange(ORDERED), len(near) - 1)]
        for i in np.flatnonzero(many < ORDERED):
            at[i] = starts[i] + np.argsort(v[starts[i] : starts[i] + counts[i]], kind="stable")[:ORDERED]
        at.sort(axis=1)
        value = np.zeros(len(texts), np.uint64)
        for j in range(ORDERED):
            value = mixed(value + labelled[at[:, j]])
        out[:, t] = value
    return out


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), np.uint64)
    if same.any():
        repeated = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        places = np.sort(order[repeated])
        places = places[np.argsort(keys[places], kind="stable")]
        new = np.concatenate([[True], keys[places][1:] != keys[places][:-1]])
        at = np.arange(len(places))
        out[places] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two arrays within a band of ``most`` diagonals to each side; ``most + 1`` if it is larger."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    lead = int(differ[0]) if len(differ) else short
    a, b, short = a[lead:], b[lead:], short - lead
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1]) if short else []
    trail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - trail], b[: len(b) - trail]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else most + 1
    if abs(n - m) > most:
        return most + 1

    def slide(i, j):
        """As far along the diagonals as both sides are equal; most stop at once."""
        inside = np.flatnonzero((i < n) & (j < m))
        for x in inside[a[i[inside]] == b[j[inside]]].tolist():
            p, q, length = int(i[x]), int(j[x]), 32
            while True:
                differ = a[p : min(p + length, n)][: m - q] != b[q : min(q + length, m)][: n - p]
                stop = int(differ.argmax()) if len(differ) else 0
                if len(differ) and not differ[stop]:
                    p, q, length = p + len(differ), q + len(differ), length * 4
                    continue
                i[x] = p + stop
                break
        return i

    # furthest row on each diagonal k = column - row, for a growing number of edits
    reach = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    low = high = 0
    for e in range(most + 1):
        k = m - n
        if low <= k <= high and reach[k - low] >= n:
            return e
        new_low, new_high = max(low - 1, -n), min(high + 1, m)
        ks = np.arange(new_low, new_high + 1)
        wide = np.full(high - low + 5, -2, np.int64)
        wide[2:-2] = reach
        base = ks - low + 2
        i = np.maximum(np.maximum(wide[base] + 1, wide[base - 1]), wide[base + 1] + 1)
        i = np.minimum(i, np.minimum(n, m - ks))
        ok = (i >= 0) & (i + ks >= 0)
        i[~ok] = -2
        live = np.flatnonzero(ok)
        i[live] = slide(i[live], i[live] + ks[live])
        reach, low, high = i, new_low, new_high
    return most + 1


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity by alignment if it reaches ``least``, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most or _shared(a, b) < longer - most:
        return 0.0
    e = edits(a, b, most)
    return 0.0 if e > most else 1 - e / longer


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of words in common, with repeats: no alignment keeps more."""
    both = np.concatenate([a, b])
    both.sort()
    ends = np.flatnonzero(np.concatenate([both[1:] != both[:-1], [True]]))
    total = np.diff(np.concatenate([[-1], ends]))
    a = np.sort(a)
    own = np.searchsorted(a, both[ends], "right") - np.searchsorted(a, both[ends], "left")
    return int(np.minimum(own, total - own).sum())


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, n_words, sketch`` of every row."""

    @trimmed
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hashes = WordHashes()
        for batch in batches_by_size(batches, 1, 2 << 20):
            texts = batch.column(1).to_pylist()
            words = [hashes(t.split()) for t in texts]
            some = [i for i, w in enumerate(words) if len(w)]
            found: list = [None] * len(texts)
            if some:
                for i, row in zip(some, sketches([words[i] for i in some]).view(np.int64).tolist(), strict=True):
                    found[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([hashlib.md5(t.encode()).digest() for t in texts], pa.binary()),
                    pa.array([len(w) for w in words], pa.int64()), pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "n_words", "sketch"],
            )

    return docs.mapInArrow(sketch, "doc_id long, digest binary, n_words long, sketch array<long>")


def _words(texts: DataFrame) -> DataFrame:
    """``rep, words``: 32-bit word hashes of each text."""

    @trimmed
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches_by_size(batches, 1):
            words = [(hashes(t.split()) >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["rep", "words"])

    return texts.select("rep", "text").mapInArrow(hashed, "rep long, words binary")


def _aligned(both: DataFrame, least: float) -> DataFrame:
    """The pairs (``a, b`` with words ``wa, wb``) with their ``similarity``: 0 where it is below ``least``."""

    @F.pandas_udf("double")
    @trimmed
    def align(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in parts:
            yield pd.Series([similarity(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), least) for a, b in zip(left, right, strict=True)], dtype=float)

    return both.select("a", "b", align("wa", "wb").alias("similarity"))


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (``a, b``) with their ``similarity``."""
    first = words.select(F.col("rep").alias("a"), F.col("words").alias("wa"))
    second = words.select(F.col("rep").alias("b"), F.col("words").alias("wb"))
    return _aligned(pairs.join(first, "a").join(second, "b"), least)


def _fits(least: float, a: str, b: str):
    """Lengths that allow the similarity."""
    return F.least(a, b) >= F.greatest(a, b) * least - 1e-6


def _fit(n: int, m: int, least: float) -> bool:
    return min(n, m) >= max(n, m) * least - 1e-6


def _in_order(least: float):
    """A function from rows ``key, rest, n, rep, label, words`` in order to links, and to the rows beside its partition's borders.

    ``border`` is null for a link (``a, b``). Else it numbers a border between partitions, ``a`` is a text of ``n`` words and
    the class ``label`` in the bucket ``key`` beside it, and ``before`` says on which side. Classes that a link joins count as
    one from there on.
    """
    names = ["border", "before", "key", "a", "b", "n", "label", "words"]
    types = [pa.int32(), pa.bool_(), *[pa.int64()] * 5, pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    @trimmed
    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        first_key = key = last = None
        firsts: list = []  # the first row of the present run of each depth
        window: list = []  # the latest row of each of the latest classes
        joined: dict = {}  # classes that links joined in the present bucket
        leading = 0  # rows of the first bucket so far
        for batch in batches:
            out = []
            for k, rest, n, rep, label, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if last is None:
                    first_key = k
                if last is None or k != key:
                    key, firsts, window, joined = k, [], [], {}
                else:
                    alike = next((d for d, (x, y) in enumerate(zip(rest, last, strict=True)) if x != y), len(rest))
                    del firsts[alike + 1 :]
                row = (rep, n, label, np.frombuffer(text, "<u4"))
                for other, m, of, words in {x[0]: x for x in firsts + window}.values():
                    here_now, there = _root(joined, label), _root(joined, of)
                    if here_now != there and other != rep and _fit(n, m, least) and similarity(row[3], words, least) >= least:
                        out.append((None, None, None, rep, other, None, None, None))
                        joined[here_now] = there
                firsts += [row] * (len(rest) + 1 - len(firsts))
                own = _root(joined, label)
                window = [w for w in window if _root(joined, w[2]) != own][-(WINDOW - 1) :] + [row]
                if key == first_key and leading < WINDOW:
                    out.append((here, False, key, rep, None, n, label, text))
                    leading += 1
                last = rest
            yield table(out)
        yield table([(here + 1, True, key, rep, None, n, label, words.tobytes()) for rep, n, label, words in window])

    return ordered


def _root(joined: dict, label: int) -> int:
    while label in joined:
        label = joined[label]
    return label


def _shape(words: np.ndarray) -> np.ndarray:
    """How many words have each of ``SHAPE`` values of their last hash bits, at most 255."""
    return np.minimum(np.bincount(words % SHAPE, minlength=SHAPE), 255).astype(np.uint8)


def close_pairs(n: np.ndarray, label: np.ndarray, block: np.ndarray, shape: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of different labels that lengths and shapes do not rule out; with two blocks, pairs across them."""
    out = []
    across = block[0] != block[-1]
    for i in range(len(n) - 1):
        if across and block[i] != block[0]:
            break
        longer = np.maximum(n[i], n[i + 1 :])
        most = ((1 - least) * longer + 1e-9).astype(np.int64)
        fit = (np.abs(n[i + 1 :] - n[i]) <= most) & (label[i + 1 :] != label[i])
        if across:
            fit &= block[i + 1 :] != block[i]
        j = np.flatnonzero(fit)
        if not len(j):
            continue
        # one edit takes at most one word from the one side and gives one to the other
        more = np.maximum(shape[i], shape[i + 1 + j])
        lost = (more - shape[i + 1 + j]).sum(axis=1, dtype=np.int64)
        gained = (more - shape[i]).sum(axis=1, dtype=np.int64)
        j = j[np.maximum(lost, gained) <= most[j]]
        if len(j):
            out.append((np.full(len(j), i), i + 1 + j))
    return out


def _rest(buckets: DataFrame, classes: DataFrame, reps: DataFrame, words: DataFrame, least: float, parts: int) -> DataFrame:
    """The links (``a, b``) among all pairs of texts of a bucket (``key, t, rep, n``) that are of different classes.

    A pair is looked at in the first of its buckets only. Classes that a link joins count as one from there on.
    """
    labelled = buckets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("g"), F.count("*").alias("size"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("total") / _BLOCK_WORDS)).cast("int")
    rows = labelled.join(several.where("l <> g").select("key", F.least(blocks, F.col("size").cast("int")).alias("blocks")), "key")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(reps.select("rep", "sketch"), "rep").join(words, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "t", "block", "rep", "n", "label", "sketch", "words")

    @trimmed
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if row[:3] != cell:
                    found += links(held)
                    cell, held = row[:3], []
                held.append(row[3:])
            yield table(found)
        yield table(links(held))

    def links(held: list[tuple]) -> list[tuple[int, int]]:
        if len({row[4] for row in held}) < 2:
            return []
        t, block, rep, n, label, sketch, text = zip(*held, strict=True)
        sketch, words = np.array(sketch), [np.frombuffer(w, "<u4") for w in text]
        out, joined = [], {}
        for i, j in close_pairs(np.array(n), np.array(label), np.array(block), np.array([_shape(w) for w in words]), least):
            first = (sketch[i] == sketch[j]).argmax(axis=1) == t[0]
            for p, q in zip(i[first].tolist(), j[first].tolist(), strict=True):
                here, there = _root(joined, label[p]), _root(joined, label[q])
                if here != there and similarity(words[p], words[q], least) >= least:
                    joined[here] = there
                    out.append((rep[p], rep[q]))
        return out

    def table(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    dealt = rows.repartition(parts, "key", "x", "y").sortWithinPartitions("key", "x", "y", "block")
    return dealt.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` for every row of ``docs`` (``doc_id, text``; other columns are not looked at).

    ``class_id`` is the least ``doc_id`` of the class, ``kept`` says whether the row's own id is that. Texts without a word
    are copies of each other only if equal. Null texts stay alone, rows without an id get no class and are kept. Rows of
    one id count as one document.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    spark = docs.sparkSession
    sketched = written(_sketched(full), "omh-sketches")
    reps = written(
        sketched.groupBy("digest").agg(F.min(F.struct("doc_id", "n_words", "sketch")).alias("first")).select(
            "digest", F.col("first.doc_id").alias("rep"), F.col("first.n_words").alias("n_words"), F.col("first.sketch").alias("sketch")
        ),
        "omh-texts",
    )
    members = reps.where("sketch IS NOT NULL").select("rep", "n_words", F.posexplode("sketch").alias("t", "value")).select(
        F.xxhash64("t", "value").alias("key"), "t", "rep", F.col("n_words").alias("n")
    )

    # the rows of buckets with more than one text, with the least text of the bucket
    stats = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("lead")).where("size > 1")
    buckets = written(members.join(stats.drop("size"), "key"), "omh-buckets")
    shared = reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "digest")
    texts = full.select(F.col("doc_id").alias("rep"), "text", F.unhex(F.md5("text")).alias("digest")).join(shared, ["rep", "digest"], "left_semi")
    words = written(_words(texts.dropDuplicates(["rep", "digest"])), "omh-words")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
        """Each pair once, without those tried. Few bytes of pairs are much work, so they stay in all partitions."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).repartition(parts, "a", "b")
        return pairs.distinct().join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")

    # at first each text with the least of its partners: large groups of copies fall together by this alone
    with_lead = buckets.where((F.col("rep") != F.col("lead.rep")) & _fits(least, "n", "lead.n")).select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
    tried = written(_verified(with_lead.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), words, least), "omh-pairs")
    links = tried.where(F.col("similarity") >= least).select("a", "b")
    classes = components(links)

    # then with the least member of each bucket
    la, lb = (classes.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b"))
    apart = with_lead.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    checked = written(_verified(untried(apart, tried), words, least), "omh-pairs")
    tried = tried.union(checked)
    new = checked.where(F.col("similarity") >= least).select("a", "b")
    links = links.union(new)
    classes = joined_components(classes, new)

    # then the buckets that still hold several classes, in order
    labelled = buckets.join(classes.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    several = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("g")).where("l <> g").select("key")
    sketch = reps.select("rep", "sketch")
    mixed_up = labelled.join(several, "key", "left_semi").join(sketch, "rep").where(F.xxhash64("t", F.element_at("sketch", F.col("t") + 1)) == F.col("key"))
    rest = F.slice(F.concat("sketch", "sketch"), F.col("t") + 2, DEPTH)
    ordered = mixed_up.select("key", rest.alias("rest"), "n", "rep", "label").join(words, "rep").select("key", "rest", "n", "rep", "label", "words")
    ordered = written(ordered, "omh-rows").repartitionByRange(parts, "key", "rest", "n", "rep").sortWithinPartitions("key", "rest", "n", "rep")
    found = written(
        ordered.mapInArrow(_in_order(least), "border int, before boolean, key long, a long, b long, n long, label long, words binary"), "omh-order"
    )
    beside = found.where("border IS NOT NULL")
    after = beside.where("NOT before").select("border", "key", *(F.col(x).alias(y) for x, y in (("a", "b"), ("n", "m"), ("label", "other"), ("words", "wb"))))
    over = beside.where("before").drop("b").join(after, ["border", "key"]).where("label <> other AND a <> b").where(_fits(least, "n", "m"))
    over = _aligned(over.select("a", "b", F.col("words").alias("wa"), "wb"), least)
    met = over.where(F.col("similarity") >= least)
    new = written(found.where("border IS NULL").select("a", "b").union(met.select("a", "b")), "omh-links")
    links = links.union(new)
    classes = joined_components(classes, new)

    # last all pairs of different classes that share a bucket, as far as their words may allow the similarity
    new = written(_rest(buckets.select("key", "t", "rep", "n"), classes, reps, words, least, parts), "omh-links")
    links = links.union(new)
    classes = joined_components(classes, new)

    # copies of a text take the class of the text; texts of one id are one document
    known = sketched.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest")
    joined = known.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = known.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    if several.isEmpty():
        label = known.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id")).distinct()
    else:
        every = components(links.select("a", "b").union(joined))
        label = known.select("doc_id").distinct().join(every.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("class_id"))
    out = own.select("doc_id").join(label, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one of the least id, with all its columns; rows without an id stay."""
    found = near_duplicates(docs, least).where(~F.col("kept")).select(F.col("doc_id").alias("doc_id_")).distinct()
    return docs.join(found, docs["doc_id"] == found["doc_id_"], "left_anti")


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    return near_duplicates(table(spark, sf_dir, "documents"))

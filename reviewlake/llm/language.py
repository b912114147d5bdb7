"""Language identification by a convolutional network over bytes, trained and run in numpy.

Lower-cased UTF-8 is cut into windows of ``SIZE`` bytes. Each byte has a learnt vector; filters of widths 2, 3 and 4
slide over the window in steps of two bytes, the largest answer of each filter (after ReLU) is kept, and a softmax
layer gives the languages. The score of a text is the mean over all windows of the whole text, weighted by the bytes
in each.

The network is fitted on a bounded sample: about ``PER_LANGUAGE`` labelled documents of each language, of each
``SLICES`` windows spread over the whole text. Its size depends on the number of languages only, and it reaches the
tasks with the function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import forget, trimmed

SIZE = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
VECTOR = 8
PER_LANGUAGE = 500
SLICES = 4
_SCALE = 1_000_000
_LETTER = re.compile(r"[^\W\d_]")


class ByteNet:
    """Byte vectors, filters and softmax; two steps of a filter share one product of byte pairs with weights."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng, n = np.random.default_rng(seed), FILTERS * len(WIDTHS)
        self.languages = languages
        self.vectors = rng.normal(0, 0.3, (256, VECTOR)).astype(np.float32)
        self.vectors[0] = 0
        mask = np.zeros((4 * VECTOR, n), np.float32)
        for k, width in enumerate(WIDTHS):
            mask[: width * VECTOR, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = mask
        self.weights = (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _answers(self, windows: np.ndarray) -> np.ndarray:
        """Answers of all filters at every second byte: (windows, steps, filters)."""
        pairs = self.vectors[windows].reshape(len(windows) * SIZE // 2, 2 * VECTOR)
        both = pairs @ np.concatenate([self.weights[: 2 * VECTOR], self.weights[2 * VECTOR :]], axis=1)
        both = both.reshape(len(windows), SIZE // 2, -1)
        n = len(self.bias)
        return both[:, :-1, :n] + both[:, 1:, n:]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self._answers(windows).max(axis=1) + self.bias, 0)
        z = pooled @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004):
        """Adam on the cross entropy; the order of the rows is the only chance, and it is seeded."""
        names = ("vectors", "weights", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        rng, step = np.random.default_rng(11), 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                step += 1
                rows = order[i : i + batch]
                for k, g in self._gradients(windows[rows], labels[rows]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                    setattr(self, k, (getattr(self, k) - rate * (1 - epoch / epochs) * move).astype(np.float32))
                self.weights *= self.mask
                self.vectors[0] = 0
        return self

    def _gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        answers = self._answers(windows)
        at = answers.argmax(axis=1)
        raw = np.take_along_axis(answers, at[:, None, :], axis=1)[:, 0] + self.bias
        pooled = np.maximum(raw, 0)
        z = pooled @ self.out + self.out_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(p)), labels] -= 1
        p /= len(p)
        down = (p @ self.out.T) * (raw > 0)  # (windows, filters): where each filter answered most
        places = 2 * at[:, :, None] + np.arange(4)
        seen = windows[np.arange(len(windows))[:, None, None], places]  # (windows, filters, 4 bytes)
        vectors = self.vectors[seen].reshape(*at.shape, 4 * VECTOR)
        weights = np.einsum("bf,bfk->kf", down, vectors)
        back = np.einsum("bf,kf->bfk", down, self.weights).reshape(-1, VECTOR)
        to = np.zeros_like(self.vectors)
        np.add.at(to, seen.reshape(-1), back)
        return {"vectors": to, "weights": weights * self.mask, "bias": down.sum(axis=0), "out": pooled.T @ p, "out_bias": p.sum(axis=0)}


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last filled up with zero bytes."""
    n = -(-len(data) // SIZE)
    return np.frombuffer(data.ljust(n * SIZE, b"\0"), np.uint8).reshape(n, SIZE)


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learnt from; those without an id are among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame) -> ByteNet | None:
    """A network fitted on a bounded sample of the labelled documents that are not held out; None without any."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(_SCALE, PER_LANGUAGE * _SCALE // n + 1))])
    place = F.xxhash64("doc_id", "text")
    chosen = known.where(F.pmod(place, F.lit(_SCALE)) < shares[F.col("lang")])
    last = F.greatest(F.length("text") - SIZE, F.lit(0))
    slices = [
        F.substring(F.col("text"), (last * (i / max(SLICES - 1, 1))).cast("int") + 1, F.lit(SIZE)).alias(f"s{i}")
        for i in range(SLICES)
    ]
    rows = chosen.orderBy(place, "doc_id").select("lang", *slices).limit(2 * PER_LANGUAGE * len(counts) + 100).collect()
    languages = sorted(counts)
    pairs = sorted({(r["lang"], s) for r in rows for s in r[1:] if _LETTER.search(s)})
    windows = np.stack([windows_of(s.lower().encode()[:SIZE])[0] for _, s in pairs])
    labels = np.array([languages.index(k) for k, _ in pairs])
    return ByteNet(languages).fit(windows, labels)


def predicted(text: Column, net: ByteNet | None) -> Column:
    """``lang`` and ``score`` of every whole text, as a struct; ``und`` and 0 for null and for texts without a letter."""

    @F.pandas_udf("lang string, score double")
    @trimmed
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for part in parts:
            texts = part.tolist()
            sums = np.zeros((len(texts), len(net.languages) if net else 1))
            queue: list[tuple[int, np.ndarray, int]] = []
            waiting = 0

            def work(queue=queue, sums=sums):
                p = net.probabilities(np.concatenate([w for _, w, _ in queue]))
                at = 0
                for i, w, n in queue:
                    weight = np.full(len(w), SIZE, float)
                    weight[-1] = n - (len(w) - 1) * SIZE
                    sums[i] += (p[at : at + len(w)] * weight[:, None]).sum(axis=0)
                    at += len(w)
                queue.clear()

            for i, text in enumerate(texts):
                if net and text and _LETTER.search(text):
                    data = text.lower().encode()
                    for a in range(0, len(data), 512 * SIZE):
                        piece = data[a : a + 512 * SIZE]
                        queue.append((i, windows_of(piece), len(piece)))
                        waiting += len(queue[-1][1])
                        if waiting >= 512:
                            work()
                            waiting = 0
            if queue:
                work()
            total = sums.sum(axis=1)
            sure = sums.max(axis=1) / np.where(total > 0, total, 1)
            names = [net.languages[k] if t > 0 else "und" for k, t in zip(sums.argmax(axis=1), total, strict=True)]
            yield pd.DataFrame({"lang": names, "score": np.clip(sure, 0, 1)})

    return predict(text)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``; others ignored).

    The network learns from the rows themselves, without those held out. Null text and text without a letter is
    ``und`` with score 0, and so is everything if nothing is labelled. Repeated rows give a row each.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang")
    found = own.select("doc_id", predicted(F.col("text"), train(own)).alias("p"))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with all their columns whose language is known with a score of at least ``least``."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    p = predicted(F.col("text").cast("string"), train(own))
    flag = "language_" + "_".join(docs.columns)  # a name that no column has
    return docs.withColumn(flag, p).where((F.col(f"`{flag}`.lang") != "und") & (F.col(f"`{flag}`.score") >= least)).drop(flag)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    return identify(table(spark, sf_dir, "documents"))

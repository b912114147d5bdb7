"""Clusters by centroids in whole numbers, with dot products from bit planes.

A vector of 64 components is kept as bit planes: plane ``b`` is one unsigned 64-bit word that holds bit ``b`` of every
component, in two's complement, so that the top plane counts negatively. The dot product of two vectors is then
``sum over planes a, b of weight(a) * weight(b) * popcount(x[a] & c[b])``, exact in 64-bit integers; squared lengths and
squared distances follow from it. Sums of the members of a cluster are made from the planes too: bits are counted by component,
and weighted once.

Each round reads the table of planes once and moves no vector: tasks return at most one partial row a centroid and component,
which Spark adds up, so that the driver sees ``k * 64`` sums whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import table, written

WIDTH = 64
SCALE = 256
# Scaled components beyond this, in absolute value, could take a squared distance out of 64 bits.
LARGEST = 2**27
_BLOCK = 2048


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: ``floor(scale * c)`` of each component, for vectors of exactly 64 components, none null or non-finite.

    Vectors with a scaled component beyond ``LARGEST`` are left out as well: their distances do not fit a long. Repeated rows
    and repeated or null ids stay, as rows of their own.
    """
    c = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale))
    number = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.forall(number, lambda e: F.coalesce(F.abs(e) < F.lit(LARGEST / scale), F.lit(False)))
    fit = vectors.where((F.size("embedding") == WIDTH) & usable)
    return fit.select(F.col("vec_id").cast("long").alias("vec_id"), c.cast("array<long>").alias("x"))


def planes_of(x: np.ndarray, planes: int) -> np.ndarray:
    """``n x planes`` words: bit ``i`` of word ``b`` is bit ``b`` of component ``i`` in two's complement."""
    bits = (x[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def weights(planes: int) -> np.ndarray:
    """What each plane counts: powers of two, the top one negative."""
    w = 2 ** np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Dot products of each of ``x`` with each of ``c``, both as planes."""
    out = np.zeros((len(x), len(c)), np.int64)
    wx, wc = weights(x.shape[1]), weights(c.shape[1])
    for a in range(x.shape[1]):
        for b in range(c.shape[1]):
            out += np.bitwise_count(x[:, a, None] & c[None, :, b]).astype(np.int64) * (wx[a] * wc[b])
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths of vectors as planes."""
    w = weights(x.shape[1])
    out = np.zeros(len(x), np.int64)
    for a in range(x.shape[1]):
        for b in range(a, x.shape[1]):
            out += np.bitwise_count(x[:, a] & x[:, b]).astype(np.int64) * (w[a] * w[b] * (1 if a == b else 2))
    return out


def sums_by_cluster(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """``k x 64`` sums of components, from bits counted by cluster, plane and component."""
    out = np.zeros((k, WIDTH), np.int64)
    w = weights(x.shape[1])
    order = np.argsort(cluster, kind="stable")
    x, cluster = np.ascontiguousarray(x[order]), cluster[order]
    there, starts = np.unique(cluster, return_index=True)
    for b in range(x.shape[1]):
        bits = np.unpackbits(np.ascontiguousarray(x[:, b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[there] += np.add.reduceat(bits.astype(np.int64), starts, axis=0) * w[b]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], planes: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(start, _BLOCK)
            yield part.column(0), np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, planes)


def _nearest(planes: int, centroids: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    c = planes_of(centroids, planes)
    cc = squares(c)

    def nearest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = squares(x)[:, None] + cc - 2 * dots(x, c)
        at = d.argmin(axis=1)  # the first of equal ones
        return at, d[np.arange(len(x)), at]

    return nearest


def _moved(packed: DataFrame, planes: int, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    nearest, k = _nearest(planes, centroids), len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for _, x in _blocks(batches, planes):
            at, _ = nearest(x)
            sums += sums_by_cluster(x, at, k)
            count += np.bincount(at, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, WIDTH)), pa.array(np.tile(np.arange(WIDTH), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(count[some], WIDTH))],
            ["cluster", "i", "s", "n"],
        )

    rows = packed.mapInArrow(partial, "cluster long, i long, s long, n long").groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in rows.collect():  # k * 64 rows
        out[r["cluster"], r["i"]] = r["s"] // r["n"]
    return out


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid`` for each vector that takes part.

    Takes ``vec_id`` and ``embedding`` of ``vectors`` and no other column. The first centroids are the ``k`` vectors (all, if
    fewer) with the least sha256 of ``seed:vec_id``; null ids come last, ties go to the lesser vector. A round assigns every
    vector to the nearest centroid, ties to the smaller number, and puts each centroid that has vectors at the floor of their
    mean; empty ones stay. Vectors are assigned once more at the end. An empty table gives no row.
    """
    spark = vectors.sparkSession
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>"
    whole = written(whole_vectors(vectors, scale), "planes-whole")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = whole.orderBy(digest.asc_nulls_last(), "x").limit(k).select("x").collect()
    if not first:
        return spark.createDataFrame([], out)
    ends = whole.agg(F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most")).first()
    planes = max((~v if v < 0 else v).bit_length() for v in ends) + 1
    centroids = np.array([r["x"] for r in first], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK):
                part = batch.slice(start, _BLOCK)
                words = planes_of(part.column(1).flatten().to_numpy().reshape(-1, WIDTH), planes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "planes"])

    packed = written(whole.mapInArrow(pack, "vec_id long, planes binary"), "planes-packed")
    for _ in range(rounds):
        centroids = _moved(packed, planes, centroids)
    nearest = _nearest(planes, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, planes):
            at, d = nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    assigned = written(packed.mapInArrow(assign, "vec_id long, cluster int, distance long"), "planes-assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    named = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), own)
        for c, own in enumerate(centroids.tolist())
    ]
    told = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return assigned.join(F.broadcast(told), "cluster").select(*[f.split()[0] for f in out.split(", ")])  # k rows at most


def op12_bit_plane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings")).drop("centroid")


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, unnest(range({WIDTH})) AS i FROM v
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT {k}
)"""]
    for r in range(rounds + 1):
        parts.append(f""", a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.vec_id, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{r} k
  ) GROUP BY vec_id
)""")
        if r < rounds:
            parts.append(f""", m{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} JOIN parts USING (vec_id) GROUP BY c, i
), c{r + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.x, k.x) AS x FROM c{r} k LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY c
  ) m USING (c)
)""")
    parts.append(f"""
SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)""")
    return "".join(parts)


OP12_SQL = _op12_sql()

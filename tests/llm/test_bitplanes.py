"""Bit-plane clusters against a plain computation in Python's whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from reviewlake.llm import bitplanes

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, x string"


def plain(rows, k=40, rounds=5):
    kept = [(r.vec_id, [math.floor(256 * float(v)) for v in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == 64 and all(v is not None and math.isfinite(v) for v in r.embedding)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in order[:k]]

    def assign():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d), x))
        return out

    for _ in range(rounds):
        by = {}
        for _, c, _, x in assign():
            by.setdefault(c, []).append(x)
        for c, xs in by.items():
            centroids[c] = [sum(col) // len(xs) for col in zip(*xs)]
    last = assign()
    inertia = {}
    for _, c, d, _ in last:
        inertia[c] = inertia.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i is None, i or 0, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d, _ in last)


def got(found):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


def data(spark, n=260, seed=1, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64)) * scale / 8
    x[40:90] = x[40]  # a large group of equal rows
    rows = [(i, [float(np.float32(v)) for v in row], 1, 7, "a") for i, row in enumerate(x)]
    one = rows[0][1]
    rows += [rows[3], (None, one, None, None, None), (900, None, 1, 1, None), (901, [], 1, 1, None), (902, one[:63], 1, 1, None), (903, [None, *one[1:]], 1, 1, None)]
    rows += [(904, [float("nan"), *one[1:]], 1, 1, None), (905, [float("-inf"), *one[1:]], 1, 1, None), (906, [0.0] * 64, 1, 1, None), (907, [-0.0] * 64, 1, 1, None), (908, [3.0e38, *one[1:]], 1, 1, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_dots_of_planes():
    rng = np.random.default_rng(3)
    for low, high in ((-256, 256), (0, 1), (-1, 0), (-5, 1000), (-(2**27), 2**27)):
        x, c = rng.integers(low, high + 1, (70, 64)), rng.integers(low, high + 1, (9, 64))
        planes = max((~v if v < 0 else v).bit_length() for v in (low, high)) + 1
        a, b = bitplanes.planes_of(x, planes), bitplanes.planes_of(c, planes)
        assert (bitplanes.dots(a, b) == x @ c.T).all()
        assert (bitplanes.squares(a) == (x * x).sum(1)).all()
        cluster = rng.integers(0, 5, 70)
        assert (bitplanes.sums_by_cluster(a, cluster, 6) == np.stack([x[cluster == k].sum(0) for k in range(6)])).all()


@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_clusters(spark, scale):
    rows = data(spark, scale=scale)
    assert got(bitplanes.clusters(rows)) == plain([r for r in rows.collect() if r.vec_id != 908])


def test_fewer_vectors_than_centroids_and_empty_ones(spark):
    few = data(spark).where("vec_id < 7 or vec_id between 45 and 60")  # equal centroids: all but the first are empty
    assert got(bitplanes.clusters(few)) == plain(few.collect())


def test_nothing(spark):
    assert bitplanes.clusters(data(spark).where("false")).collect() == []
    assert bitplanes.clusters(data(spark).where("vec_id >= 900 and vec_id < 906")).collect() == []


def test_rows_of_many_partitions(spark):
    rows = data(spark, 120)
    assert got(bitplanes.clusters(rows.repartition(13), k=5, rounds=2)) == plain(rows.where("vec_id is null or vec_id <> 908").collect(), 5, 2)

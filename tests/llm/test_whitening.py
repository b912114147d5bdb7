"""Whitening against numpy's own eigenvectors and whole-number sums."""

import math

import numpy as np
import pytest

from reviewlake.llm import whitening
from reviewlake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n int, x string, i int"


def expected(rows, wanted=4):
    kept = [(r.vec_id, tuple(math.floor(256 * float(v)) for v in r.embedding)) for r in rows if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)]
    lengths = [len(x) for _, x in kept]
    width = min((-lengths.count(w), w) for w in lengths)[1]
    kept = [(i, x) for i, x in kept if len(x) == width]
    fit = sorted({x for _, x in kept})
    n, s = len(fit), [sum(col) for col in zip(*fit)]
    centred = np.array(fit) - np.array(s) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    out = []
    for i, x in kept:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        white = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
        out += [(i, c + 1, n, deviation, white[c], e[c] / np.trace(v)) for c in range(len(e))]
    return out


def check(found, want):
    found = sorted(found.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in found] == [w[:4] for w in want]
    for c in {w[1] for w in want}:
        a = np.array([r.whitened for r in found if r.component == c])
        b = np.array([w[4] for w in want if w[1] == c])
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-9
    assert np.allclose([r.explained for r in found], [w[5] for w in want], rtol=1e-9)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


def data(spark, n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(1, 2, d)) / 4 + 0.3
    x[100:250] = x[100]
    rows = [(i, [float(np.float32(v)) for v in row], 1, 5, "a", 1) for i, row in enumerate(x)]
    one = rows[0][1]
    rows += [rows[7], (None, one, None, None, None, None), (900, None, 1, 1, None, 1), (901, [], 1, 1, None, 1), (902, one[1:], 1, 1, None, 1), (903, [None, *one[1:]], 1, 1, None, 1)]
    rows += [(904, [float("nan"), *one[1:]], 1, 1, None, 1), (905, [float("inf"), *one[1:]], 1, 1, None, 1), (906, [0.0] * d, 1, 1, None, 1), (907, [-0.0] * d, 1, 1, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_whiten(spark):
    rows = data(spark)
    check(whitening.whiten(rows), expected(rows.collect()))


def test_many_partitions_and_few_dimensions(spark):
    rows = data(spark, d=3).repartition(11)
    check(whitening.whiten(rows), expected(rows.collect(), 3))


def test_query_on_the_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(QUERIES["op13_whitening"][0](spark, sf), expected(rows.collect()))


def test_little(spark):
    rows = data(spark)
    assert whitening.whiten(rows.where("false")).collect() == []
    assert whitening.whiten(rows.where("vec_id between 900 and 901 or vec_id between 903 and 905")).collect() == []
    assert whitening.whiten(rows.where("vec_id between 100 and 200")).collect() == []  # one distinct vector
    two = whitening.whiten(rows.where("vec_id in (1, 2)")).collect()  # rank one
    assert {r.component for r in two} == {1} and sorted(round(abs(r.whitened), 9) for r in two) == [1.0, 1.0] and abs(two[0].explained - 1) < 1e-9


def test_large_numbers_stay_exact():
    x = np.array([[2**29, -5], [7, 2**20]])
    assert whitening._deviation(x, 3, [11, -4]) == [(3 * 2**29 - 11) ** 2 + 121, 100 + (3 * 2**20 + 4) ** 2]
    assert whitening._deviation(x, 10**6, [1, 1])[0] is None


@pytest.mark.parametrize("spectrum", [
    np.arange(1, 41), np.r_[np.ones(36), 5, 5, 5, 5], np.r_[np.ones(39), 100], np.ones(40), np.r_[np.zeros(30), np.arange(1, 11)],
    np.r_[np.linspace(1, 1.0001, 36), 1.00011, 1.00012, 1.00013, 1.00014], 10.0 ** np.arange(-20, 20), np.r_[np.ones(30), np.full(10, 2.0)],
])
def test_components_of_hard_spectra(spectrum):
    n = len(spectrum)
    u = np.linalg.qr(np.random.default_rng(1).normal(size=(n, n)))[0]
    v = u @ np.diag(spectrum.astype(float)) @ u.T
    v = (v + v.T) / 2
    values, vectors = whitening.components(v, 4)
    size = np.abs(v).max()
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:4]).max() < 1e-12 * size
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * size
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 30):
        a = rng.normal(size=(n, n))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        d, b = whitening.tridiagonal(a)
        for shift in rng.normal(size=20) * 4:
            assert whitening.above(d, b, shift) == (e > shift).sum()

"""Eigenvectors against a dense solver, and whitened rows against a brute-force version."""

import numpy as np
import pytest

from triagelake.llm import whitening


def operator(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = q * np.array(values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 40), [5.0] * 20 + [1.0] * 20, np.geomspace(1e-6, 1e6, 30), [3.0, 0, 0, 0, 0], [0.0] * 19 + [7.0], [2.0], [2.0, 2.0],
    np.concatenate([np.linspace(60, 66, 180), [150.0]]), np.arange(400) ** 0.5 + 10, 1 / np.arange(1, 300),
], ids=str)
def test_leading_pairs_equal_a_dense_solver(values):
    a, calls = operator(values), []

    def product(q):
        calls.append(q.shape[1])
        return a @ q

    found, vectors = whitening.jacobi_davidson(product, len(a), 16)
    k = min(16, len(a))
    top = max(values)
    assert found.shape == (k,) and np.abs(found - np.sort(np.linalg.eigvalsh(a))[::-1][:k]).max() <= 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12 and np.linalg.norm(a @ vectors - vectors * found, axis=0).max() <= 1e-11 * top
    assert len(calls) < 400


def test_minres_solves_shifted_systems():
    a = operator(np.linspace(1, 3, 25))
    right, shifts = np.random.default_rng(2).normal(size=(25, 3)), np.array([0.5, 2.01, 3.5])
    x = whitening.minres(lambda m: a @ m, right, shifts, 60, 1e-13)
    assert np.abs(a @ x - shifts * x - right).max() < 1e-8
    assert (whitening.minres(lambda m: a @ m, np.zeros((25, 3)), shifts, 5, 0.1) == 0).all()


def expected(rows, k=16):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in good], dtype=object).reshape(len(good), width)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    c = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    some = values[::-1] > values[-1] * 1e-13
    values, vectors = values[::-1][some][:k], vectors[:, ::-1][:, some][:, :k]
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    return [i for i, _ in good], n, deviation, ((x * n - sums) / n).astype(float) @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


def check(got, rows, k=16):
    ids, n, deviation, whitened, share = expected(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert len(got) == len(ids) * len(share) and {r.identity_error for r in got} <= {got[0].identity_error} and got[0].identity_error < 1e-10
    sign = None
    for i, dev, row in zip(ids, deviation, whitened):
        mine = sorted(by[i], key=lambda r: r.component)
        each = len(mine) // ids.count(i)
        assert each == len(share) and {r.deviation for r in mine} == {dev} and {r.n for r in mine} == {n}
        mine = mine[:: ids.count(i)]
        assert [r.component for r in mine] == list(range(1, len(share) + 1)) and np.allclose([r.explained for r in mine], share, rtol=1e-10)
        w = np.array([r.whitened for r in mine])
        if sign is None and np.abs(row).min() > 1e-3:
            sign = np.sign(w) * np.sign(row)
        if sign is not None:
            assert np.abs(w * sign - row).max() < 1e-7


def test_whitened_rows_of_the_given_vectors(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(whitening.query(spark, data).collect(), rows)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=5)]) for k in range(60)]
    rows += [rows[4], (90, rows[4][1]), (None, rows[5][1]), (91, rows[6][1][:3]), (92, []), (93, [0.0] * 5)]
    odd = [(94, None), (95, [None, 1.0]), (96, [float("nan")]), (97, [float("-inf"), 1.0])]
    df = spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows + odd], "vec_id long, embedding array<float>, x string, n int, component double")
    got = whitening.whiten(df).collect()
    check(got, rows)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id = 3")).collect() == []
    flat = spark.createDataFrame([(k, [float(k % 3), 1.0, 1.0]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_a_deviation_beyond_a_long_is_an_error():
    w = object.__new__(whitening.Whitening)
    w.n, w.sums = 10**9, np.array([0, 0])
    with pytest.raises(OverflowError):
        w.deviation(np.array([[10, 10]]))

"""Whitening against a dense eigendecomposition; null, odd, equal and repeated vectors; narrow blocks of wide vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthweave.llm import whitening as wh

COLS = "vec_id bigint, embedding array<float>"


def vectors(n, d, seed=0, decay=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) * decay ** np.arange(d)).astype(np.float32)


def dense(v):
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    c = z / n
    values, q = np.linalg.eigh(c.T @ c / n)
    values, q = values[::-1], q[:, ::-1]
    return n, (z.astype(object) ** 2).sum(axis=1), values, c @ q / np.sqrt(np.maximum(values, 1e-30)), values / values.sum()


def check(rows, ids, v, k):
    n, deviation, values, white, explained = dense(v)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(got) == len(ids) * k
    sign = {c: np.sign(got[ids[0], c]["whitened"] * white[0, c - 1]) for c in range(1, k + 1)}
    for i, key in enumerate(ids):
        for c in range(1, k + 1):
            r = got[key, c]
            assert r["n"] == n and r["deviation"] == deviation[i]
            assert abs(r["whitened"] - sign[c] * white[i, c - 1]) < 1e-6
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("n,d,decay", [(300, 12, 0.9), (600, 64, 1.0), (300, 120, 0.95)])
def test_against_dense(spark, n, d, decay):
    v = vectors(n, d, decay=decay)
    data = [(i, x) for i, x in enumerate(v.tolist())] + [(9001, None), (9002, []), (9003, [1.0] * (d - 1)), (9004, [float("nan")] * d),
                                                         (9005, [None] + [1.0] * (d - 1)), (9006, [float("inf")] * d)]
    df = spark.createDataFrame(data, COLS).withColumns({c: F.lit("clash") for c in ("id", "x", "v", "task", "component")})
    check(wh.whitened(df).collect(), list(range(n)), v, min(32, d))


def test_filter_narrower_than_the_space(spark):
    """The block stays narrower than the vectors, and the residuals certify it."""
    v = vectors(500, 100, decay=0.97)
    rows = wh.integer_vectors(spark.createDataFrame(list(enumerate(v.tolist())), COLS))
    cov = wh.Covariance(rows, wh.centre(rows))
    values, q, rest = wh.leading(cov, 10, 6)
    want = dense(v)[2][:10]
    assert q.shape == (100, 10) and np.allclose(values, want, rtol=1e-10) and rest.max() <= wh.GOOD * values[0]
    assert np.abs(q.T @ q - np.eye(10)).max() < 1e-12


def test_nearly_equal_eigenvalues(spark):
    """A cluster across the block's border: the block grows until it is certified."""
    base = np.concatenate([np.eye(60), -np.eye(60)]).astype(np.float32)
    rows = wh.integer_vectors(spark.createDataFrame(list(enumerate(base.tolist())), COLS))
    values, q, rest = wh.leading(wh.Covariance(rows, wh.centre(rows)), 8, 4)
    assert len(values) == 8 and np.allclose(values, values[0]) and rest.max() <= wh.GOOD * values[0]


def test_without_variance(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for data in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        got = wh.whitened(spark.createDataFrame(data, COLS))
        assert got.columns == names and got.count() == 0
    line = [(None if i == 2 else 1, [float(i), 2.0 * i, 1.0]) for i in range(6)]
    got = wh.whitened(spark.createDataFrame(line, COLS)).collect()
    assert len(got) == 6 and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-9 for r in got)


def test_exact_beyond_64_bits():
    at = wh.Centre(10 ** 13, [10 ** 19 + 3, 5])
    x = np.array([[1_000_000, 7], [1_000_001, 0]])
    z = at.scaled(x)
    assert z.tolist() == [[10 ** 19 - 10 ** 19 - 3, 7 * 10 ** 13 - 5], [10 ** 13 - 3, -5]]
    with pytest.raises(OverflowError):
        at.deviations(x)

import numpy as np
import pytest

from leadlake.llm import whitening as W

KIND = "vec_id bigint, embedding array<float>, label int"


def brute(x):
    """n, deviations, eigenvalues, whitened rows (up to sign) and shares of the trace, by plain numpy."""
    x = np.floor(64 * x.astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    centred = x - s / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, deviation, values, centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def made(seed, n, d):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(3, 0.5, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d)
    x[: n // 3] = x[0]  # a third are copies
    return x.astype(np.float32)


def check(rows, x, ids, most):
    n, deviation, _, white, explained = brute(x)
    k = min(most, x.shape[1])
    assert len(rows) == len(x) * k
    by = {(r.vec_id, r.component): r for r in rows}
    for c in range(k):
        got = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(got @ white[:, c])
        assert np.abs(got - sign * white[:, c]).max() < 1e-6
    for i, d in zip(ids, deviation, strict=True):
        r = by[i, 1]
        assert (r.n, r.deviation) == (n, d)
    for c in range(k):
        assert by[ids[0], c + 1].explained == pytest.approx(explained[c], rel=1e-6)
    [error] = {r.identity_error for r in rows}
    assert 0 <= error < 1e-6


@pytest.mark.parametrize("n, d, block", [(400, 12, 64), (90, 40, W.BLOCK)])
def test_against_plain_numpy(spark, monkeypatch, n, d, block):
    monkeypatch.setattr(W, "BLOCK", block)
    x = made(n, n, d)
    table = spark.createDataFrame([(5 * i, v.tolist(), 0) for i, v in enumerate(x)], KIND).repartition(7)
    check(W.whiten(table).collect(), x, [5 * i for i in range(n)], 32)


def test_query_over_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.collect()
    check(W.whiten(table).collect(), np.array([r.embedding for r in rows], np.float32), [r.vec_id for r in rows], 32)


def test_eigen_without_variance():
    values, project, explained = W.eigen(np.diag([4.0, 0.0, 8.0]), 2, 3)
    assert values.tolist() == [4, 2, 0] and np.allclose(np.abs(project), [[0, 0.5**0.5, 0], [0, 0, 0], [0.5, 0, 0]])
    assert explained.tolist() == pytest.approx([2 / 3, 1 / 3, 0])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [0.0, 1.0], 0), (None, [2.0, 2.5], None), (3, None, 0), (4, [], 0), (5, [nan, 1.0], 0),
            (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [1.0, 2.0, 3.0], 0)]
    table = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as index", "2 as x", "3 as w", "4 as h", "5 as one", "6 as n")
    out = W.whiten(table).collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in out) == [-1, -1, 1, 1, 2, 2, 2, 2, 8, 8, 8]
    alone = [r for r in out if r.vec_id == 8]
    assert all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 0.0) for r in alone)
    assert all(r.n == 4 and r.identity_error < 1e-9 for r in out if r.vec_id != 8)
    assert W.whiten(table.limit(0)).count() == 0 and W.whiten(table.where("vec_id between 3 and 7")).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 0.0], 0)], KIND)
    got = W.whiten(huge).collect()
    assert len(got) == 6 and all(r.deviation is None or r.deviation >= 0 for r in got)

import hashlib

import numpy as np
import pytest

from leadlake.llm import centroids as C

KIND = "vec_id bigint, embedding array<float>, label int"


def brute(ids, x, clusters, rounds):
    """Every vector against every centroid, in Python's own numbers."""
    x = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    order = sorted(range(len(x)), key=lambda i: hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest())
    centres = [x[i].tolist() for i in order[:clusters]]

    def assign():
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for v in x.tolist()]
        return [min(range(len(centres)), key=lambda c: (row[c], c)) for row in d], [min(row) for row in d]

    for _ in range(rounds):
        own, _ = assign()
        for c in range(len(centres)):
            members = [x[i].tolist() for i in range(len(x)) if own[i] == c]
            if members:
                centres[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    return (*assign(), centres)


def made(seed, n, dim):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(5, dim))[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * 0.3
    x[: n // 3] = x[0]  # a third are copies
    x[n // 3: n // 2] = np.round(x[n // 3: n // 2])  # ties of integer distances
    return x.astype(np.float32)


def test_pivot_bounds_leave_no_nearer_centroid_out():
    rng = np.random.default_rng(0)
    for dim, spread in ((2, 3), (8, 100), (64, 5000)):
        x = rng.integers(-spread, spread, (2000, dim))
        centres = np.concatenate([x[:30], x[:5], x[:5] + 1])
        pivots = C.choose_pivots(centres)
        far = np.sqrt(C._squared(x, pivots).astype(float))
        own, least, exact = C.Assigner.of(centres, pivots).assign(x, far)
        every = C._squared(x, centres)
        assert (own == every.argmin(1)).all() and (least == every.min(1)).all()
        assert exact < (0.7 if dim < 64 else 1.01) * every.size


@pytest.mark.parametrize("n, dim, clusters", [(300, 6, 12), (9, 3, 40)])
def test_clusters_against_brute_force(spark, n, dim, clusters):
    x = made(n, n, dim)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND).repartition(5)
    assigned, centres = C.cluster(table, dim, clusters, 3)
    own, least, expected = brute(range(n), x, clusters, 3)
    assert centres.tolist() == expected
    assert {r.vec_id: (r.cluster, r.distance) for r in assigned.collect()} == {i: (own[i], least[i]) for i in range(n)}


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [rng.normal(size=64).tolist() for _ in range(5)]
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, 0) for i, v in enumerate(good)] + [
        (0, good[0], 1), (None, good[1], 0), (10, None, 0), (11, [], 0), (12, good[0][:63], 0), (13, [nan] + good[0][1:], 0),
        (14, [inf] + good[0][1:], 0), (15, [None] + good[0][1:], None), (16, [3e38] * 64, 0), (17, [-3e38] * 64, 0)]
    table = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as cluster", "2 as q", "3 as far", "4 as own", "5 as distance")
    out = C.digests(table).collect()
    assert sorted(-1 if r.vec_id is None else r.vec_id for r in out) == [-1, 0, 0, 1, 2, 3, 4, 16, 17]
    assert {r.inertia for r in out} == {0} and all(r.distance == 0 for r in out)
    assert C.digests(table.limit(0)).count() == 0 and C.digests(table.where("vec_id > 9 and vec_id < 16")).count() == 0
    few = C.cluster(table, 64, 2, 5)[0].collect()
    assert len(few) == len(out) and all(r.distance >= 0 for r in few)


def test_sums_of_the_digest(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = C.digests(table).collect()
    assert len(rows) == table.count() and {r.inertia for r in rows} == {sum(r.distance for r in rows)}
    for r in rows[:50]:
        assert r.cluster_inertia == sum(o.distance for o in rows if o.cluster == r.cluster)

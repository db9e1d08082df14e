import numpy as np
import pytest

from leadlake.llm import vectors as V

KIND = "vec_id bigint, embedding array<float>, label int"


def clusters(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.2, 0.4], n)[:, None]
    x[: n // 10] = x[n // 10 : 2 * (n // 10)]  # equal vectors
    x[n // 5] = 3 * x[n // 5 + 1]  # the same direction
    return x.astype(np.float32)


def brute(x, ids):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], 1 << 40).min(1))
        if (new == label).all():
            return hit.sum(1), label
        label = new


@pytest.mark.parametrize("block", [V.BLOCK, 37])
def test_links_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    x = clusters(1, 400)
    rows = V.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], KIND)).collect()
    links, label = brute(x, range(len(x)))
    assert links.sum() > 1000 and len(set(label)) > 20
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], label[r.vec_id], label[r.vec_id] == r.vec_id)
    assert len(rows) == len(x)


def planted(seed, n, dim=64):
    """Unit-like vectors without structure, half of them at cosine 0.9 to 1 to another one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    half = n // 2
    cosine = rng.uniform(0.9, 1, n - half)
    base = x[rng.integers(0, half, n - half)]
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    x[half:] = 3 * (cosine[:, None] * base + np.sqrt(1 - cosine**2)[:, None] * aside)
    return x.astype(np.float32)


def test_recall_on_a_planted_table(spark):
    n = 20_000
    x = planted(3, n)
    ids = np.random.default_rng(1).permutation(n)
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], KIND).repartition(8)
    got = {r.vec_id: r for r in V.near_vectors(table).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = np.concatenate([(u[i:i + 1000] @ u.T >= 0.95).sum(1) - 1 for i in range(0, n, 1000)])
    found = np.array([got[int(i)].n_links for i in ids])
    asked = ids % 20 == 0
    recall, recall_asked = found.sum() / true.sum(), found[asked].sum() / true[asked].sum()
    print(f"recall {recall:.4f}, of ids divisible by 20 {recall_asked:.4f}, links {true.sum()}")
    assert (found <= true).all() and true.sum() > 10_000 and recall > 0.97 and recall_asked > 0.97


def test_probes_are_few():
    x = V.unit(planted(4, 20_000))
    index = V.Index.fit(x, 20_000 // V.PER_LIST)
    probes = index.nearest_lists(x[:500], V.PROBES)
    assert len(index.coarse) > 130 and (probes >= 0).all() and all(len(set(p)) == V.PROBES for p in probes.tolist())
    assert V.PROBES < 0.1 * len(index.coarse)
    every = np.argsort(V._squares(x[:500], index.coarse), 1)[:, 0]
    assert (probes[:, 0] == every).mean() > 0.9
    assert (index.top_of(probes[:, 0]) < len(index.tops)).all() and index.first[-1] == len(index.coarse)


def test_table_distances_leave_out_only_what_is_far():
    x = V.unit(clusters(2, 500))
    index = V.Index.fit(x[:300], 7)
    own = index.nearest_lists(x, 1)[:, 0]
    codes, error = index.encode(x, own)
    true = np.sqrt(V._squares(x, x))
    for i in range(len(x)):
        tables = index.tables(x[i:i + 1], own[i])
        inside = np.flatnonzero(own == own[i])
        far = np.sqrt(sum(t[0, codes[inside, j]] for j, t in enumerate(tables)))
        assert (np.abs(far - true[i, inside]) <= error[inside] + 1e-3).all()


def test_every_length_is_compared(spark):
    rows = [(i, [1.0, 0.01 * i], 0) for i in range(4)] + [(10 + i, [1.0, 0.0, 0.01 * i], 0) for i in range(3)] + [(20, [1.0], 0), (21, [2.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {**{i: (3, 0) for i in range(4)}, **{10 + i: (2, 10) for i in range(3)}, 20: (1, 20), 21: (1, 20)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [None, 1.0], 0),
            (8, [], 0), (None, [1.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (1, [1.0, 0.0], 0), (10, [1e-30, 0.0], 0)]
    table = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as node", "2 as list", "3 as k1", "4 as links", "5 as component")
    got = V.near_vectors(table).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(r.n_links == 3 and r.component_id == 1 for r in got if r.vec_id in (1, 2, 10))
    for i in (3, 4, 5, 6, 7, 8, 9, None):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert V.near_vectors(table.limit(0)).count() == 0
    assert V.near_vectors(table.where("vec_id in (3, 4)")).count() == 2

"""Leaf-wise boosting against a tree grown by trying every split."""

import numpy as np
import pytest

from leadlake.operators import boosting as B


def made(seed, n):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.normal(size=n), rng.integers(0, 3, n), rng.normal(size=n)], 1).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 6) * 0.6 - 2 * x[:, 1] * (x[:, 2] == 1)))).astype(float)
    x[rng.random(n) < 0.1, 3] = np.nan
    return x, y


def brute(bins, g, h, leaves, l2, least, depth=None):
    """Best leaf first, every split of every leaf tried: [(rows, feature, bin, gain)] and the leaves' rows."""
    def best(rows):
        found = (0.0, None)
        for f in range(bins.shape[1]):
            for b in np.unique(bins[rows, f])[:-1]:
                left = rows[bins[rows, f] <= b]
                right = rows[bins[rows, f] > b]
                if min(len(left), len(right)) >= least:
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
                    gain = part(left) + part(right) - part(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, int(b), left, right))
        return found

    open_, done = [(*best(np.arange(len(g))), np.arange(len(g)), 0)], []
    while len(open_) < leaves:
        i = max(range(len(open_)), key=lambda k: open_[k][0] if open_[k][1] and (depth is None or open_[k][3] < depth) else -1)
        gain, split, rows, level = open_[i]
        if not split or (depth is not None and level >= depth):
            break
        done.append((len(rows), split[0], split[1], gain))
        open_.pop(i)
        open_ += [(*best(part), part, level + 1) for part in split[2:]]
    return done, [o[2] for o in open_]


@pytest.mark.parametrize("leaves, l2, least, depth", [(31, 0.0, 5, None), (9, 1.0, 20, None), (32, 1.0, 1, 3)])
def test_a_tree_against_every_split(spark, leaves, l2, least, depth):
    x, y = made(leaves, 700)
    rows = spark.createDataFrame([(i, float(t), *v) for i, (t, v) in enumerate(zip(y, x.tolist(), strict=True))], "id bigint, y double, a double, b double, c double, d double").repartition(4)
    settings = B.Settings(rounds=1, leaves=leaves, l2=l2, least_rows=least, depth=depth, bins=16)
    model = B.fit(rows, ["a", "b", "c", "d"], "y", "id", settings)
    for i, e in enumerate(model.edges):
        v = x[~np.isnan(x[:, i]), i]
        assert np.allclose(e, np.unique(np.quantile(v, np.arange(1, 16) / 16)))
    bins = np.stack([np.where(np.isnan(x[:, i]), len(e) + 1, np.searchsorted(e, x[:, i], side="left")) for i, e in enumerate(model.edges)], 1)
    p = np.full(len(y), y.mean())
    g, h = p - y, p * (1 - p)
    done, parts = brute(bins, g, h, leaves, l2, least, depth)
    tree = model.trees[0]
    got = sorted((round(s.gain, 6), s.feature, s.bin) for s in tree.splits.values())
    assert got == sorted((round(gain, 6), f, b) for _, f, b, gain in done)
    assert len(tree.values) == len(parts) == len(tree.splits) + 1 <= leaves
    values = np.zeros(len(y))
    for rows_ in parts:
        values[rows_] = -settings.rate * g[rows_].sum() / (h[rows_].sum() + l2)
    assert np.allclose(tree.scores(bins), values)
    expected = 1 / (1 + np.exp(-(np.log(y.mean() / (1 - y.mean())) + values)))
    assert np.allclose([r.probability for r in model.score(rows).orderBy("id").collect()], expected)


def test_boosting_learns_and_odd_tables(spark):
    x, y = made(1, 1500)
    rows = spark.createDataFrame([(i, float(t), *v) for i, (t, v) in enumerate(zip(y, x.tolist(), strict=True))], "id bigint, y double, a double, b double, c double, d double")
    settings = B.Settings(rounds=4, leaves=8, rate=0.5, columns=0.75, rows=0.8, least_rows=10, bins=32)
    model = B.fit(rows.where("id % 3 > 0"), ["a", "b", "c", "d"], "y", "id", settings)
    assert len(model.trees) == 4 and all(len({s.feature for s in t.splits.values()}) <= 3 for t in model.trees)
    held = model.score(rows.where("id % 3 = 0")).collect()
    p, t = np.array([r.probability for r in held]), np.array([r.y for r in held])
    assert ((p > 0.5) == t).mean() > max(t.mean(), 1 - t.mean()) + 0.1
    one = B.fit(rows.where("y = 1"), ["a"], "y", "id", B.Settings(rounds=1))
    assert one.trees[0].splits == {} and one.score(rows.limit(3)).count() == 3
    none = B.fit(rows.limit(0), ["a", "b"], "y", "id", B.Settings(rounds=1))
    assert [r.probability for r in none.score(rows.limit(2)).collect()] == [0.5, 0.5]

import numpy as np
from pyspark.sql import functions as F

from leadlake.llm import classifier as C


def objective(x, places, grades, used, ridge=1e-3):
    """The penalised mean of -log P(grade), written out row by row; x: weights of the used features, then the two thresholds."""
    weight, cuts = dict(zip(used, x[:-2], strict=True)), [-np.inf, x[-2], x[-1], np.inf]
    total = 0.0
    for p, g in zip(places, grades, strict=True):
        score = sum(weight.get(int(f), 0.0) for f in p)
        below = [1 / (1 + np.exp(-(c - score))) for c in cuts]
        total -= np.log(below[g + 1] - below[g])
    return total / len(places) + ridge / 2 * sum(v * v for v in x[:-2])


def test_the_fit_has_no_gradient():
    """At the fitted weights and thresholds the numeric gradient of the likelihood vanishes, elsewhere it does not."""
    rng = np.random.default_rng(0)
    kinds = [np.array([1, 2]), np.array([3, 4, 4]), np.array([1, 4]), np.array([5])]
    chosen = rng.integers(0, 4, 240)
    places = [kinds[k] for k in chosen]
    grades = np.array([rng.choice(3, p=p) for p in np.array([[.6, .3, .1], [.1, .3, .6], [.3, .4, .3], [.2, .2, .6]])[chosen]])
    used = [1, 2, 3, 4, 5]

    def gradient(x):
        steps = np.eye(len(x)) * 1e-5
        return np.array([(objective(x + s, places, grades, used) - objective(x - s, places, grades, used)) / 2e-5 for s in steps])

    model = C.fit(places, grades, steps=3000)
    x = np.append(model.weights[used], model.thresholds)
    assert model.thresholds[0] < model.thresholds[1] and np.count_nonzero(model.weights) == len(used)
    assert np.abs(gradient(x)).max() < 1e-4 < np.abs(gradient(x + 0.1)).max()


def test_scores_against_a_plain_scorer(spark, documents):
    """expected grade and tails by summing the weights of a text's features one by one."""
    rng = np.random.default_rng(1)
    model = C.OrdinalModel(rng.normal(size=1 << C.BITS) * 0.1, np.array([-0.7, 0.9]))
    texts = ["", "one two two three", "Fünf, sechs! #*$ sieben " * 40, "a" * 5000, "x y " * 300, None]
    rows = {r.doc_id: r for r in C.score(documents(*enumerate(texts)), model).collect()}
    for i, t in enumerate(texts):
        total = sum(float(model.weights[p]) for p in C.features(t or ""))
        tails = [1 / (1 + np.exp(c - total)) for c in model.thresholds]
        assert np.allclose([rows[i].expected_grade, rows[i].p_clean, rows[i].p_good], [sum(tails), *tails])
        assert rows[i].kept == (tails[1] >= 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    cut = F.col("doc_id") % 4 == 0
    model = C.train(docs, labels.where(~cut))
    rows = C.score(docs, model).join(labels.where(cut).withColumn("grade", C.grade()), "doc_id").where("grade is not null").toPandas()
    right = rows["kept"] == (rows["grade"] == 2)
    assert right.mean() > 0.96
    assert rows[rows.grade == 0]["kept"].mean() < 0.1 and rows[rows.grade == 2]["kept"].mean() > 0.97
    assert rows.groupby("grade")["expected_grade"].mean().is_monotonic_increasing


def test_bound_and_order(spark, documents):
    docs = documents(*[(i, "good words here" if i % 2 else "bad stuff there") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (999, 1, 1), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    a, b = C.train(docs, labels, most=30), C.train(docs.repartition(7), labels.repartition(5), most=30)
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()
    rows = {r.doc_id: r for r in C.score(docs, a).collect()}
    assert rows[1].kept and not rows[2].kept and rows[1].expected_grade > rows[2].expected_grade


def test_odd_rows(spark, odd, documents):
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, None), (8, None, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = C.train(odd, labels)
    rows = C.score(odd, model).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(0 <= r.p_good <= r.p_clean <= 1 for r in rows)
    none = C.train(documents(), labels)
    assert {r.p_good for r in C.score(odd, none).collect()} == {0.5}
    assert C.score(documents(), model).count() == 0

"""Feature vectors: dictionary of levels, scaling, many levels, save and load."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from leadlake.operators import clean as C
from leadlake.operators.preprocess import Preprocessor, level_slots
from leadlake.session import store


@pytest.fixture(scope="module")
def clean(spark):
    rng = np.random.default_rng(5)
    data = [(i, None if i % 7 == 0 else float(rng.integers(0, 50)), ["a", "b", "c", "rare", None][min(int(rng.integers(0, 45)) // 11, 4)], "x")
            for i in range(600)]
    rows = spark.createDataFrame(data, "lead_key bigint, total_visits double, channel string, city string")
    return store(C.clean_frame(rows, keep=["lead_key"]))


def test_vectors_against_numpy(clean):
    prep = Preprocessor(["total_visits"], ["channel", "city"]).fit(clean)
    rows = prep.apply(clean.withColumn("extra", F.lit(1))).select("lead_key", "total_visits", "channel", vector_to_array("features").alias("v")).collect()
    x = np.array([np.nan if r.total_visits is None else r.total_visits for r in rows])
    filled = np.where(np.isnan(x), np.nanmedian(x), x)
    z = (filled - filled.mean()) / filled.std()
    counts = {}
    for r in rows:
        counts[r.channel or "Unknown"] = counts.get(r.channel or "Unknown", 0) + 1
    frequent = {v for v, n in counts.items() if n >= 25}
    assert "rare" in counts and prep.sizes["channel"] == len(frequent) + 1 and prep.sizes["city"] == 2
    slots = {r.value: r.slot for r in prep.levels.where("feature = 'channel'").collect()}
    assert set(slots) == frequent and sorted(slots.values()) == list(range(len(frequent)))
    assert len(rows) == 600 and prep.width == 1 + len(frequent) + 1 + 2
    for r, expected in zip(rows, z, strict=True):
        hot = [0.0] * (len(frequent) + 1)
        hot[slots.get(r.channel or "Unknown", len(frequent))] = 1.0
        assert r.v[0] == pytest.approx(expected) and r.v[1:-2] == hot and r.v[-2:] == [1.0, 0.0]


def test_unseen_levels_share_the_last_slot(spark, clean, tmp_path):
    prep = Preprocessor(["total_visits"], ["channel"]).fit(clean)
    facts = prep.save(str(tmp_path))
    back = Preprocessor.load(spark, str(tmp_path), facts)
    odd = clean.limit(20).withColumn("channel", F.lit("never seen"))
    for p in (prep, back):
        vectors = [r.v for r in p.apply(odd).select(vector_to_array("features").alias("v")).collect()]
        assert len(vectors) == 20 and all(v[-1] == 1.0 and sum(v[1:]) == 1.0 for v in vectors)


def test_a_hundred_thousand_levels(spark):
    rows = spark.range(2_600_000, numPartitions=8).select(
        F.col("id").alias("lead_key"), F.concat(F.lit("level-"), (F.col("id") % 104_000).cast("string")).alias("city"),
        (F.col("id") % 10).cast("double").alias("total_visits"))
    clean = C.clean_frame(rows, keep=["lead_key"])
    prep = Preprocessor(["total_visits"], ["city"]).fit(clean)
    assert prep.sizes == {"city": 104_001}
    assert prep.levels.agg(F.count_distinct("slot")).first()[0] == 104_000
    made = prep.apply(clean.where("lead_key % 100 = 0")).select("lead_key", F.unwrap_udt("features").alias("v"))
    got = made.agg(F.count("*").alias("n"), F.max(F.size("v.indices")).alias("most"), F.count_distinct("v.indices").alias("different"),
                   F.min("v.size").alias("size")).first()
    assert (got.n, got.most, got.size) == (26_000, 2, 104_002) and got.different >= 1_040


def test_slots_run_over_buckets(spark):
    table = spark.range(30_000).select(F.lit("f").alias("feature"), F.col("id").cast("string").alias("value"))
    slots = [r.slot for r in level_slots(table).collect()]
    assert sorted(slots) == list(range(30_000))


def test_without_numbers_or_levels(clean):
    only = Preprocessor([], ["channel"]).fit(clean).apply(clean)
    assert only.count() == 600 and set(only.columns) == {*clean.columns, "features"}
    plain = Preprocessor(["total_visits"], ["occupation"]).fit(clean)
    assert plain.sizes == {} and plain.apply(clean).select(vector_to_array("features").alias("v")).first().v is not None

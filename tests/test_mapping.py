"""Mapping proposals: similarity, one claim per field, order independence, confirmation."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlake.functions.similarity import common_subsequence, field_names, token_set_similarity
from leadlake.operators import mapping as MP

HUB = pd.DataFrame({
    "source_id": "hub", "hs_object_id": [f"h{i}" for i in range(60)],
    "hs_analytics_num_visits": [str(i % 9) for i in range(60)],
    "hs_analytics_num_page_views": [str(i % 20) for i in range(60)],
    "hs_analytics_source": ["ORGANIC_SEARCH" if i % 2 else "PAID_SEARCH" for i in range(60)],
    "jobtitle": ["Manager" if i % 3 else "Student" for i in range(60)],
    "country": ["India" if i % 2 else "USA" for i in range(60)],
    "is_converted": [str(i % 2) for i in range(60)],
    "internal_widget_ref": [f"w{i}" for i in range(60)],
})


def propose(spark, frame, confirmed=None):
    df = spark.createDataFrame(frame)
    profile = MP.column_profile(df, [c for c in frame.columns if c != "source_id"])
    held = spark.createDataFrame(confirmed, "source_id string, column string, field string") if confirmed else None
    return {r["column"]: r for r in MP.propose_mapping(profile, held).collect()}


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        diagonal = 0
        for j, other in enumerate(b, 1):
            diagonal, row[j] = row[j], (diagonal + 1 if ch == other else max(row[j], row[j - 1]))
    return row[-1]


def indel_ratio(a, b):
    return 2.0 * subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_set_ratio(a, b):
    """The plain form: whole texts of shared and rest tokens are compared."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 1.0
    base = " ".join(sorted(shared))
    texts = [f"{base} {' '.join(sorted(x - shared))}".strip() for x in (left, right)]
    return max(indel_ratio(x, y) for x, y in ([(base, texts[0]), (base, texts[1])] if base else []) + [tuple(texts)])


def test_expressions_against_the_plain_form(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    names = [" ".join(word() for _ in range(rng.randint(0, 5))) for _ in range(60)] + [n for _, n in field_names()[::7]]
    names += ["x" * 59 + "ab", "x" * 130 + " y", ("abc " * 50).strip(), "", "a", "lead source detail", "source"]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(600)] + [(n, n) for n in names]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", common_subsequence(F.col("a"), F.col("b")).alias("lcs"), token_set_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert r.lcs == subsequence(r.a, r.b), (r.a, r.b)
        assert r.s == pytest.approx(token_set_ratio(r.a, r.b)), (r.a, r.b)


def test_similarity():
    assert indel_ratio("abc", "abc") == 1.0 and indel_ratio("abcd", "bd") == pytest.approx(4 / 6)
    assert token_set_ratio("number of sessions", "sessions number of") == 1.0
    assert token_set_ratio("lead source detail", "source") == 1.0
    assert token_set_ratio("amount", "country") < 0.72
    assert token_set_ratio("", "x") == 0.0


def test_hub_columns(spark):
    got = {c: r["canonical_field"] for c, r in propose(spark, HUB).items()}
    assert got["hs_object_id"] == "external_id" and got["hs_analytics_num_visits"] == "total_visits"
    assert got["hs_analytics_source"] == "channel" and got["jobtitle"] == "occupation"
    assert got["country"] == "country" and got["is_converted"] == "converted"
    assert got["internal_widget_ref"] is None


def test_column_order_does_not_matter(spark):
    shuffled = HUB[["source_id", *reversed([c for c in HUB.columns if c != "source_id"])]]
    a, b = propose(spark, HUB), propose(spark, shuffled)
    assert {c: r["canonical_field"] for c, r in a.items()} == {c: r["canonical_field"] for c, r in b.items()}


def test_one_claim_per_field_and_conflict(spark):
    frame = pd.DataFrame({"source_id": "s", "country": ["A", "B"] * 20, "country_region": ["A", "B"] * 20, "visits": ["1", "2"] * 20})
    got = propose(spark, frame)
    fields = [r["canonical_field"] for r in got.values() if r["canonical_field"]]
    assert len(fields) == len(set(fields)) and "country" in fields
    assert {got["country"]["method"], got["country_region"]["method"]} & {"conflict"}


def test_confirmed_pairs_hold_their_field(spark):
    got = propose(spark, HUB, [("hub", "internal_widget_ref", "total_visits")])
    assert got["internal_widget_ref"]["method"] == "confirmed" and got["internal_widget_ref"]["confidence"] == 1.0
    assert got["hs_analytics_num_visits"]["canonical_field"] != "total_visits"


def test_contradicting_data_asks_for_review(spark):
    frame = pd.DataFrame({"source_id": "s", "totalvisits": ["many", "few"] * 20})
    row = propose(spark, frame)["totalvisits"]
    assert row["canonical_field"] == "total_visits" and row["needs_review"]


def test_merge_moves_a_field_and_rejects_a_column(spark):
    shape = "source_id string, column string, field string"
    mapping = spark.createDataFrame([("s", "A", "city"), ("s", "B", "country")], shape)
    fixes = spark.createDataFrame([("s", "C", "city", 0), ("s", "B", None, 1)], shape + ", position int")
    got = {r["column"]: r["field"] for r in MP.merge_confirmations(mapping, fixes).collect()}
    assert got == {"C": "city"}
    wrong = spark.createDataFrame([("s", "C", "no_such_field", 0)], shape + ", position int")
    with pytest.raises(Exception, match="Unknown canonical field"):
        MP.merge_confirmations(mapping, wrong).collect()


def test_summary_text(spark):
    df = spark.createDataFrame(HUB)
    proposals = MP.propose_mapping(MP.column_profile(df, [c for c in HUB.columns if c != "source_id"]))
    row = MP.mapping_summary(proposals).first()
    assert row["unmapped"] == 1 and "  unmapped: internal_widget_ref" in row["summary"]
    assert f"{row['confident']} column(s) mapped confidently" in row["summary"]

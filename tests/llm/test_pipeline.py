"""The pipeline on small tables, each stage held against the brute force of its own input."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pyspark.sql.functions as F
from leadlake.llm import queries, stages
from leadlake.session import store

from .test_minhash import classes
from .test_mixing import fill  # noqa: F401  the same budgets
from .test_packing import Tokenizer, WORDS
from .test_quality import Q
from .test_suffix import S, brute_words


def _covered(texts):
    """Per text the bytes that a string of 400 bytes, or a run of 51 words, which stands elsewhere too covers."""
    many = Counter(t[i:i + S.LENGTH] for t in texts for i in range(len(t) - S.LENGTH + 1))
    out = []
    for t, words in zip(texts, brute_words(texts, 51), strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - S.LENGTH + 1):
            if many[t[i:i + S.LENGTH]] > 1:
                gone[i:i + S.LENGTH] = True
        places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        for j in words:
            gone[places[j][0]:places[j + 1][0] if j + 1 in words else places[j][1]] = True
        out.append(gone)
    return out


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, sf))
        before, after = ({r.doc_id: r for r in t.collect()} for t in (docs, out))
        seen[name] = len(after)
        if name != "packing":
            assert out.columns == docs.columns and set(after) <= set(before) and out.count() == len(after)
        if name == "quality_rules":
            w = Q.corpus_weights(docs, Q.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet")))
            kept = docs.select("doc_id", Q.verdict(F.col("text"), w)["kept"].alias("k")).where("k").collect()
            assert set(after) == {r.doc_id for r in kept}
        if name == "minhash_near_dedup":
            of = classes([(r.doc_id, r.text) for r in before.values()])
            assert set(after) == set(of.values())
        if name == "suffix_array_dedup":
            assert set(after) == set(before)
            whole = [r.text.encode() for r in before.values()]
            for r, gone in zip(before.values(), _covered(whole), strict=True):
                kept = bytes(np.frombuffer(r.text.encode(), np.uint8)[~gone])
                assert after[r.doc_id].text == kept.decode("utf-8", "ignore")
        if name == "mixing_sources":
            mixed = stages.mixing.mix(stages.mixing.with_domain(docs), stages.mixing.LEVELS, stages.mixing.WEIGHTS, 0.9, 1, 42)
            assert set(after) == {r.doc_id for r in mixed.where("copies = 1").collect()}
        if name == "packing":
            model = Tokenizer.from_file(WORDS)
            total = {r.doc_id: len(model.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
            assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == total
        docs = out
    assert 0 < seen["packing"] <= seen["mixing_sources"] < seen["suffix_array_dedup"] <= seen["minhash_near_dedup"] < seen["quality_rules"] < 200


def test_run_is_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 50 and "sequence_id" in rows.columns


def test_odd_rows_through_all_stages(spark, odd, documents):
    sf = "/root/testdata/sf0.001"
    for start in (odd, documents()):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = store(stage(spark, docs, sf))
            if name != "packing":
                assert out.columns == docs.columns
            docs = out


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "mixing_sources", "packing"]

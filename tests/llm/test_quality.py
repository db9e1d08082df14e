import math
import re
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlake.llm import quality as Q


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def token_hash(t):
    return xxhash.xxh64_intdigest(t.encode(), 42)


def pair_hash(a, b):
    first = xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)
    return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), first)


def grams(text):
    h = [token_hash(t) for t in re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text)]
    return [x >> (64 - Q.BITS) for x in h] + [pair_hash(a, b) >> (64 - Q.BITS) for a, b in zip(h, h[1:], strict=False)]


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def weights(texts, good):
    raw, trusted = Counter(), Counter()
    for i, t in texts:
        raw.update(grams(t or ""))
        if i in good:
            trusted.update(grams(t or ""))
    share = sum(trusted.values()) / max(1, sum(raw.values()))
    out = [0.0] * Q.BUCKETS
    for b, n in raw.items() if trusted else []:
        out[b] = round(math.log((trusted[b] + Q.PRIOR) / (n * share + Q.PRIOR)), 4)
    return out


def check(docs, trusted):
    w = Q.corpus_weights(docs, trusted)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    expected = weights(texts, {r.doc_id for r in trusted.collect() if r.doc_id is not None})
    assert all(abs(a - b) < 2e-4 for a, b in zip(w, expected, strict=True))
    rows = docs.select("doc_id", "text", Q.verdict(F.col("text"), w).alias("v")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text, v = r.text or "", r.v
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words) == base(text)
        failed = v.n_words < 10 or 100 * v.n_repeat_words > 20 * v.n_words
        g = grams(text)
        llr = sum(w[b] for b in g) / len(g) if g else 0.0
        assert abs(v.llr - llr) < 1e-9
        assert v.base_failed == failed and v.kept == (not failed and v.llr >= Q.LEAST)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, Q.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet")))


def test_odd_rows(spark, odd, documents):
    ids = spark.createDataFrame([(3,), (None,), (99,), (3,)], "doc_id bigint")
    check(odd, ids)
    none = spark.createDataFrame([], "doc_id bigint")
    assert set(Q.corpus_weights(odd, none)) == {0.0}
    assert set(Q.corpus_weights(documents(), ids)) == {0.0}
    assert documents().select(Q.verdict(F.col("text"), [0.0] * Q.BUCKETS)).count() == 0


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(list("ab \n\t|#é😀\x0b\xa0")), max_size=200), min_size=30, max_size=30))
def test_counts_of_any_text(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows.select("text", Q.verdict(F.col("text"), [0.0] * Q.BUCKETS).alias("v")).collect()
    for r in got:
        assert (r.v.n_words, r.v.word_chars, r.v.n_symbols, r.v.n_dup_lines, r.v.n_repeat_words) == base(r.text)


def test_keeps_the_good_and_drops_the_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", Q.verdict(F.col("text"), Q.corpus_weights(docs, Q.trusted_ids(labels))).alias("v"))
    counts = {(r.quality, r.kept): r["count"] for r in rows.join(labels, "doc_id").where("not v.base_failed").groupBy("quality", "v.kept").count().collect()}
    assert counts.get((0, True), 0) == 0 and counts.get((1, False), 0) == 0

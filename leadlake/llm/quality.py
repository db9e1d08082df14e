"""Quality rules: counted rules of a text, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed token n-grams (one and two tokens; a token is a run of letters
and digits or a run of other visible characters) are estimated: one from the trusted
documents, one from the raw corpus, which is all documents. A document's score is the mean
log ratio of its n-grams, so length does not matter, and a document is kept if its score is
at least ``least``. There is no sampling: the same corpus gives the same verdicts.

Both multinomials have a Dirichlet prior of ``PRIOR`` expected trusted counts a bucket, so
an n-gram that is rare in both says nothing, while a frequent one that trusted texts lack
counts heavily.

At scale: counts are summed per task before the shuffle, and there are ``BUCKETS`` of them,
whatever the corpus; they come to the driver, and the weights go back as one literal array.
Each text is shuffled once, for its label. All of it is DataFrame functions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, words_of

BITS = 14
BUCKETS = 1 << BITS
PRIOR = 4.0
LEAST = -0.25

_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
_SYMBOLS = "#*$%&|<>"
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS).cast("int")


def _token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _pairs(hashes: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` the hash of each two neighbours."""
    places = F.when(F.size(hashes) > 1, F.sequence(F.lit(1), F.size(hashes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: of(F.xxhash64(F.get(hashes, i - 1), F.get(hashes, i))))


def _grams(text: Column) -> Column:
    """The buckets of all n-grams of a text."""
    return let(_token_hashes(text), lambda h: F.concat(F.transform(h, _bucket), _pairs(h, _bucket)))


def corpus_weights(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> list[float]:
    """The log ratio of each bucket, to four decimals.

    ``trusted`` has the ids of trusted documents, repeats and nulls allowed. Without any
    trusted document, or any document, all weights are 0.
    """
    marks = trusted.select(F.col(id_column).alias("id")).where("id is not null").distinct().withColumn("mark", F.lit(1))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    texts = texts.join(marks.hint("merge"), "id", "left")  # the labels grow with the documents: the same plan at every size
    grams = texts.select("mark", F.explode(_grams(F.col("text"))).alias("bucket"))
    rows = grams.groupBy("bucket").agg(F.count("mark").alias("good"), F.count("*").alias("raw")).collect()  # BUCKETS at most
    good, raw = sum(r["good"] for r in rows), sum(r["raw"] for r in rows)
    weights = [0.0] * BUCKETS
    for r in rows if good else []:
        weights[r["bucket"]] = round(math.log((r["good"] + PRIOR) / (r["raw"] * good / raw + PRIOR)), 4)
    return weights


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows of ``window`` words that stand at least twice in the text.

    Windows are compared by 64-bit hashes of word hashes. Sorting their (hash, place) pairs
    brings equal ones together, so a text costs n log n whatever it repeats.
    """
    last = F.size(words) - window

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(places, k + 1) - p, F.lit(window))))
        return F.aggregate(reach, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def places_of(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda x, k: (
            ((k > 0) & (F.get(pairs, k - 1)["h"] == x["h"])) | F.coalesce(F.get(pairs, k + 1)["h"] == x["h"], F.lit(False))
        ))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def of_windows(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, let(let(pairs, places_of), covered)).otherwise(F.lit(0).cast("bigint"))

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(window)]),
        )

    word_hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last > 0, let(let(word_hashes, windows), of_windows)).otherwise(F.lit(0).cast("bigint"))


def _counts(text: Column, words: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return [
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.translate(text, _SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
    ]


def verdict(text: Column, weights: list[float], least: float = LEAST) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    A null text counts as empty: it has no words, fails the base rules and has llr 0.
    """
    text = F.coalesce(text, F.lit(""))
    w = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # folded to a literal array

    def mean(h: Column) -> Column:
        none = F.lit(0.0)
        one = F.aggregate(h, none, lambda a, x: a + F.get(w, _bucket(x)))
        two = F.aggregate(_pairs(h, _bucket), none, lambda a, b: a + F.get(w, b))
        return F.when(F.size(h) > 0, (one + two) / (2 * F.size(h) - 1)).otherwise(none)

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return F.struct(
            *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"), c["llr"].alias("llr"), (~failed & (c["llr"] >= least)).alias("kept"),
        )

    llr = let(_token_hashes(text), mean).alias("llr")
    return let(let(words_of(text), lambda words: F.struct(*_counts(text, words), llr)), judged)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids whose label says good quality and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")

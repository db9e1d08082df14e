"""A quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = logistic(threshold_j - score): all grades share one vector of hashed text
weights, and the thresholds are ordered. The score is a sum over the distinct tokens of a
text (runs of word characters or of other visible characters, lower case), each with the
weights of the token and of its first five characters, and over how often tokens repeat. A
text's expected grade and the probability of the top grade follow, and it is selected when
that probability is at least ``least``.

The model is fitted on at most ``MOST_LABELLED`` labelled rows, taken in hash order; this is
the only bound. Their feature numbers, not their texts, come to the driver. Every document is
scored, whole, where it lies: no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LABELLED = 8_000
BITS = 18
LEAST_DOCUMENTS = 4  # training documents in which a feature must stand to have a weight
PREFIX = 5

_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


@lru_cache(maxsize=200_000)
def _places(token: str) -> tuple[int, ...]:
    return (_place("w" + token), _place("p" + token[:PREFIX])) if len(token) > PREFIX else (_place("w" + token),)


def features(text: str) -> np.ndarray:
    """The places of a text's features, repeats included."""
    tokens = _TOKEN.findall(text.lower())
    distinct = set(tokens)
    places = [p for t in distinct for p in _places(t)]
    places.append(_repeat(len(tokens), len(distinct)))
    return np.array(places, np.int32)


def _repeat(tokens: int, distinct: int) -> int:
    """How often tokens repeat, beyond what a longer text does anyway."""
    usual = max(1.0, tokens ** 0.25)
    return _place(f"r{int(2 * np.log2(tokens / distinct / usual)) if distinct else 'none'}")


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than the grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..., a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit(places: list[np.ndarray], grades: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 1e-3) -> OrdinalModel:
    """Full-batch Adam with a falling rate on the penalised likelihood.

    Thresholds stay ordered: the first is free, the gaps are exponentials. Features of fewer
    than LEAST_DOCUMENTS documents keep weight 0. Grades absent from the rows leave their
    thresholds to the prior; no rows at all give a model that says 1/2 everywhere.
    """
    top = 2
    size = 1 << BITS
    if not len(grades):
        return OrdinalModel(np.zeros(size), np.zeros(top))
    seen = np.zeros(size, np.int32)
    for p in places:
        seen[np.unique(p)] += 1
    places = [p[seen[p] >= LEAST_DOCUMENTS] for p in places]
    rows = np.repeat(np.arange(len(places), dtype=np.int32), [len(p) for p in places])
    flat = np.concatenate(places)
    own, flat = np.unique(flat, return_inverse=True)
    free = np.concatenate([np.zeros(len(own)), [-1.0, 0.5]])
    m, v = np.zeros_like(free), np.zeros_like(free)

    def logistic(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    for step in range(1, steps + 1):
        w, first, gap = free[:-2], free[-2], np.exp(free[-1])
        score = np.bincount(rows, w[flat], minlength=len(places))
        cut = np.array([-np.inf, first, first + gap, np.inf])
        high, low = cut[grades + 1] - score, cut[grades] - score
        a, b = logistic(high), logistic(low)
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        by_score = da - db  # derivative of -log p
        gradient = np.empty_like(free)
        gradient[:-2] = np.bincount(flat, by_score[rows], minlength=len(own)) / len(places) + ridge * w
        by_first = -(da * (grades == 0)).sum() + (db * (grades == 1)).sum()
        by_second = -(da * (grades == 1)).sum() + (db * (grades == 2)).sum()
        gradient[-2] = (by_first + by_second) / len(places)
        gradient[-1] = by_second * gap / len(places)
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient ** 2
        free = free - rate * (1 - (step - 1) / steps) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(size)
    weights[own] = free[:-2]
    return OrdinalModel(weights, np.array([free[-2], free[-2] + np.exp(free[-1])]))


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 for toxic, 1 for poor, 2 for good; null where neither says anything."""
    return (
        F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2).cast("int")
    )


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> OrdinalModel:
    """Fit on the first ``most`` labelled documents in the order of a hash of their id.

    A document with several labels counts with its lowest grade. Labels without a document,
    documents without a label, and null ids take no part.
    """
    graded = labels.select(F.col("doc_id").alias("id"), grade().alias("grade")).dropna()
    chosen = graded.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"))
    found = texts.join(F.broadcast(chosen), "id")  # ``most`` rows of two numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "grade": batch["grade"], "places": [features(t or "") for t in batch["text"]]})

    rows = found.mapInPandas(run, "id bigint, grade int, places array<int>").toPandas()
    rows = rows.sort_values("id", kind="stable")  # the fit does not depend on the order of tasks
    return fit([np.asarray(p, np.int32) for p in rows["places"]], rows["grade"].to_numpy(np.int64))


def score(docs: DataFrame, model: OrdinalModel, least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade, p_good, p_clean, kept.

    p_clean is the probability of a grade above toxic. A null text counts as empty. Repeated
    rows get a row each, extra columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        weights = model.weights.tolist()
        of: dict[str, float] = {}
        for batch in batches:
            scores = []
            for text in batch["text"]:
                tokens = _TOKEN.findall((text or "").lower())
                distinct = set(tokens)
                if len(of) > 500_000:
                    of.clear()
                total = weights[_repeat(len(tokens), len(distinct))]
                for token in distinct:
                    value = of.get(token)
                    if value is None:
                        value = of[token] = sum(weights[p] for p in _places(token))
                    total += value
                scores.append(total)
            tails = model.tails(np.array(scores, float))
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "expected_grade": tails.sum(1), "p_good": tails[:, -1],
                "p_clean": tails[:, 0], "kept": tails[:, -1] >= least,
            })

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return chosen.mapInPandas(run, "doc_id bigint, expected_grade double, p_good double, p_clean double, kept boolean")

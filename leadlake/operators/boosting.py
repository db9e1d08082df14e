"""Gradient boosting of leaf-wise trees over feature histograms that Spark aggregates.

Values are cut into at most ``bins`` bins once, at exact quantiles. A tree grows best leaf first: of all
leaves the one whose best split gains most is split next, until ``leaves`` leaves or no split that gains.
The gain of a split has an L2 term on leaf values; a tree sees a seeded share of the columns and rows.

Rows keep their bins and score in a stored table. In a wave every task adds gradient, curvature and
count per (node, feature, bin) of its rows, Spark sums these histograms, and the best split of
each node is a window over its bins; nodes x features x bins rows are all that is shuffled. Leaf-wise order needs
the gains of children only when their parent is split, so a wave opens all leaves that the best-first
order may still split, and a tree costs as many waves as it is deep, not as it has leaves.
The driver holds the tree: its splits, a row per node.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from leadlake.operators.ranks import exact_quantiles
from leadlake.session import store


@dataclass(frozen=True)
class Split:
    """Rows of ``feature`` in ``bin`` or a lower one go to ``left``, the others, and missing values, to ``right``."""

    feature: int
    bin: int
    gain: float
    left: int
    right: int


@dataclass
class Tree:
    """Node 0 is the root; a node without a split is a leaf with a value."""

    splits: dict[int, Split] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.splits):  # a child's number is above its parent's
            s = self.splits[node]
            here = at == node
            at[here] = np.where(bins[here, s.feature] <= s.bin, s.left, s.right)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        leaves = self.leaf_of(bins)
        out = np.zeros(len(bins))
        for node, value in self.values.items():
            out[leaves == node] = value
        return out


@dataclass(frozen=True)
class Settings:
    rounds: int = 350
    leaves: int = 31
    depth: int | None = None
    rate: float = 0.05
    l2: float = 0.0
    columns: float = 1.0
    rows: float = 1.0
    least_rows: int = 25
    bins: int = 255
    seed: int = 42


#: The settings of the two boosted learners of the ensemble.
BOOSTED_A = Settings(leaves=32, depth=5, l2=1.0, columns=0.9, rows=0.9, least_rows=1)
BOOSTED_B = Settings()


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _bins_of(columns: Sequence[pa.Array], edges: list[list[float]]) -> np.ndarray:
    """How many edges are below each value; missing values get one more than any."""
    made = []
    for column, e in zip(columns, edges, strict=True):
        v = column.to_numpy(zero_copy_only=False).astype(float)
        made.append(np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v, side="left")))
    return np.stack(made, 1)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Upper edges per feature: the distinct exact quantiles; bins x features numbers reach the driver."""
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).cast("double").alias("value")) for i, c in enumerate(features)])))
    found = exact_quantiles(long.where(~F.isnan("value")), "value", [k / bins for k in range(1, bins)], ["feature"]).collect()
    edges: list[set[float]] = [set() for _ in features]
    for r in found:
        edges[r["feature"]].add(r["quantile"])
    return [sorted(e) for e in edges]


def _binned(rows: DataFrame, features: Sequence[str], edges: list[list[float]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``bins``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _bins_of(batch.columns[:len(edges)], edges).astype(np.int16)
            yield pa.RecordBatch.from_arrays([*batch.columns[len(edges):], pa.array(list(matrix), pa.list_(pa.int16()))], names=[*keep, "bins"])

    chosen = rows.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)], *keep)
    kinds = dict(rows.dtypes)
    return chosen.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", bins array<smallint>")


def histograms(data: DataFrame, tree: Tree, nodes: Sequence[int], columns: Sequence[int]) -> DataFrame:
    """(node, feature, bin, g, h, n) of the rows that stand at ``nodes``; data has bins, g, h."""
    wanted, chosen = np.array(sorted(nodes), np.int64), list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 << 9
        sums = np.zeros((3, len(wanted) * len(chosen) * width))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _matrix(batch.column(0), batch.num_rows)
            g, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            leaf = tree.leaf_of(bins)
            place = np.searchsorted(wanted, leaf)
            here = (place < len(wanted)) & (wanted[np.minimum(place, len(wanted) - 1)] == leaf)
            for j, f in enumerate(chosen):
                at = (place[here] * len(chosen) + j) * width + bins[here, f]
                for k, w in enumerate((g[here], h[here], None)):
                    sums[k] += np.bincount(at, w, minlength=sums.shape[1])
        some = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([
            pa.array(wanted[some // width // len(chosen)], pa.int64()), pa.array(np.array(chosen)[some // width % len(chosen)], pa.int32()),
            pa.array(some % width, pa.int32()), *[pa.array(s[some]) for s in sums[:2]], pa.array(sums[2][some].astype(np.int64))],
            names=["node", "feature", "bin", "g", "h", "n"])

    parts = data.select("bins", "g", "h").mapInArrow(run, "node bigint, feature int, bin int, g double, h double, n bigint")
    return parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def best_splits(sums: DataFrame, l2: float, least_rows: int) -> DataFrame:
    """A row per node: its totals, and the split of greatest gain (gain null if none is allowed).

    gain = gl^2 / (hl + l2) + gr^2 / (hr + l2) - g^2 / (h + l2); ties go to the lower feature, then the lower bin.
    """
    ahead = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # 512 bins at most
    whole = Window.partitionBy("node", "feature")
    run = sums.select("node", "feature", "bin", *[F.sum(c).over(ahead).alias(f"{c}l") for c in ("g", "h", "n")],
                      *[F.sum(c).over(whole).alias(c) for c in ("g", "h", "n")])
    part = lambda g, h: g * g / F.nullif(h + l2, F.lit(0.0))
    gain = part(F.col("gl"), F.col("hl")) + part(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - part(F.col("g"), F.col("h"))
    allowed = (F.col("nl") >= least_rows) & (F.col("n") - F.col("nl") >= least_rows)
    # rounded, so that the order of a distributed sum cannot decide between equal splits
    scored = run.withColumn("gain", F.when(allowed & (gain > 1e-9), F.round(gain, 9)))
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return scored.groupBy("node").agg(
        F.max(F.when(F.col("gain").isNotNull(), order)).alias("_s"), F.min(F.struct("feature", "g", "h", "n")).alias("_t")).select(
        "node", "_s.gain", (-F.col("_s.f")).alias("feature"), (-F.col("_s.b")).alias("bin"), "_t.g", "_t.h", "_t.n")


def grow(data: DataFrame, columns: Sequence[int], settings: Settings) -> Tree:
    """One leaf-wise tree on rows with bins, g (gradient) and h (curvature)."""
    tree, depth = Tree(), {0: 0}
    found: dict[int, dict] = {}
    fresh = [0]
    while fresh:
        for r in best_splits(histograms(data, tree, fresh, columns), settings.l2, settings.least_rows).collect():  # a row per open node
            found[r["node"]] = r.asDict()
        # Best-first over what is known. A node whose children are not known yet may only be split if
        # it is; its children's gains come with the next wave.
        tree, order, opened = Tree(), [], []
        heap = [(-found[0]["gain"], 0)] if found.get(0, {}).get("gain") else []
        made = 1
        while heap and made < settings.leaves:
            _, node = heapq.heappop(heap)
            order.append(node)
            made += 1
            for child in _children(node, depth):
                if child in found:
                    if found[child]["gain"] and (settings.depth is None or depth[child] < settings.depth):
                        heapq.heappush(heap, (-found[child]["gain"], child))
                else:
                    opened.append(child)
        for node in sorted(order):
            s = found[node]
            left, right = _children(node, depth)
            tree.splits[node] = Split(s["feature"], s["bin"], s["gain"], left, right)
        fresh = opened
    for node in {c for s in tree.splits.values() for c in (s.left, s.right)} - set(tree.splits) or {0}:
        f = found.get(node)
        tree.values[node] = -settings.rate * f["g"] / (f["h"] + settings.l2) if f and f["h"] + settings.l2 > 0 else 0.0
    return tree


def _children(node: int, depth: dict[int, int]) -> tuple[int, int]:
    left, right = 2 * node + 1, 2 * node + 2
    depth[left] = depth[right] = depth[node] + 1
    return left, right


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]

    def score(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        """Adds ``out``, the probability of label 1, in one pass."""
        trees, start, edges = self.trees, self.start, self.edges
        numbers = rows.select(F.struct(*rows.columns).alias("_row"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(self.features)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _bins_of(batch.columns[1:], edges)
                total = np.full(batch.num_rows, start)
                for tree in trees:
                    total += tree.scores(bins)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-total)))], names=["_row", "_p"])

        made = numbers.mapInArrow(run, T.StructType([numbers.schema["_row"], T.StructField("_p", T.DoubleType())]))
        return made.select(*[F.col("_row").getField(c).alias(c) for c in rows.columns if c != out], F.col("_p").alias(out))


def fit(rows: DataFrame, features: Sequence[str], label: str, id_column: str, settings: Settings = BOOSTED_B) -> Boosted:
    """Boosts ``settings.rounds`` trees on the log loss; rows without a label are left out.

    A tree's rows and columns are chosen by a hash of seed, round and id or number. Each
    round's scores are a stored table, which cuts the lineage.
    """
    features = list(features)
    known = rows.where(F.col(label).isNotNull()).select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("y"), *features)
    edges = bin_edges(known, features, settings.bins)
    data = store(_binned(known, features, edges, ["id", "y"]).withColumn("score", F.lit(0.0)))
    rate = data.agg(F.avg("y")).first()[0]
    rate = min(max(0.5 if rate is None else rate, 1e-6), 1 - 1e-6)
    model = Boosted(features, edges, float(np.log(rate / (1 - rate))), [])
    for number in range(settings.rounds):
        random = np.random.default_rng([settings.seed, number])
        most = max(1, round(settings.columns * len(features)))
        columns = sorted(random.permutation(len(features))[:most].tolist())
        p = 1.0 / (1.0 + F.exp(-(F.col("score") + model.start)))
        seen = F.pmod(F.xxhash64("id", F.lit(settings.seed), F.lit(number)), F.lit(1 << 20)) < int(settings.rows * (1 << 20))
        tree = grow(data.where(seen).select("bins", (p - F.col("y")).alias("g"), (p * (1 - p)).alias("h")), columns, settings)
        model.trees.append(tree)
        if number + 1 < settings.rounds:
            data = store(_advanced(data, tree))
    return model


def _advanced(data: DataFrame, tree: Tree) -> DataFrame:
    """The rows with the tree's values added to their scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch.column(2), batch.num_rows)
            score = batch.column(3).to_numpy(zero_copy_only=False) + tree.scores(bins)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=batch.schema.names)

    return data.select("id", "y", "bins", "score").mapInArrow(run, data.select("id", "y", "bins", "score").schema)

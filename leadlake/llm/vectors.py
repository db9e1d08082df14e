"""Near-duplicate embeddings by an inverted file with product quantisation.

Vectors are scaled to length 1, where a cosine of ``least`` is a distance R = sqrt(2 - 2 least).
Coarse centroids cut them into inverted lists; the rest of a vector after its centroid is kept
as one code per subspace, with the length of what the codes miss (its error). Lists stand in a tree: a
few tops, each with its own lists, so a vector meets the centroids of some tops alone, however many lists there are.

A query probes the ``PROBES`` nearest lists under its ``TOPS`` nearest tops. Inside a list the
asymmetric distance (query as it is, partners by table look-up of their codes) is off by at
most the partner's error, so whatever it leaves out is surely farther than R. What is left gets its exact
cosine in double precision, so every link reported is one. A link is missed only if neither end
probes the other's list; the README has the recall measured against all pairs.

At scale. Equal vectors are one node with a count from the start. The index is fitted on at
most SAMPLE vectors, taken in hash order, and every vector is indexed. Lists grow in number with the vectors (one for every
``PER_LIST``, at most MOST_LISTS). Queries travel once for each top they ask. A top may hold a third
of all vectors: its members and the queries that ask it are cut into blocks of about BLOCK rows,
a task compares two blocks, and it returns counts per node and links to one root per
connected piece of the block, never all pairs. An end that the other does not probe is counted where it was found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import inline_table
from leadlake.llm.graph import components
from leadlake.session import store

SAMPLE, MOST_LISTS = 65_536, 4_096
PER_LIST = 128
PROBES, TOPS = 12, 4
SUBSPACES, CODES = 8, 256
BLOCK = 4_096
ROUNDS = 8
SLACK = 1e-5  # more than single precision can be off


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i:i + 4096], y).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def _centres(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; an empty cluster keeps its centre."""
    centres = x[random.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        many = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[many > 0] = sums[many > 0] / many[many > 0, None]
    return centres


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass(frozen=True)
class Index:
    tops: np.ndarray  # tops x dimensions
    coarse: np.ndarray  # lists x dimensions, top by top
    first: np.ndarray  # the lists of top t: first[t] .. first[t + 1]
    books: list[np.ndarray]  # per subspace: codes x its dimensions
    cuts: list[int]

    @staticmethod
    def fit(sample: np.ndarray, lists: int) -> Index:
        random = np.random.default_rng(0)
        x = unit(sample)
        tops = _centres(x, max(1, math.isqrt(lists)), random)
        own = _nearest(x, tops)
        share = np.maximum(1, np.round(lists * np.bincount(own, minlength=len(tops)) / len(x)).astype(int))
        parts = [x[own == t] if (own == t).any() else tops[[t]] for t in range(len(tops))]
        coarse = np.concatenate([_centres(part, min(int(k), len(part)), random) for part, k in zip(parts, share, strict=True)])
        first = np.concatenate([[0], np.cumsum([min(int(k), len(part)) for part, k in zip(parts, share, strict=True)])])
        index = Index(tops, coarse, first, [], [])
        rest = x - coarse[index.nearest_lists(x, 1)[:, 0]]
        cut = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        books = [_centres(rest[:, p], min(CODES, max(1, len(x))), random) for p in cut]
        return Index(tops, coarse, first, books, [int(p[0]) for p in cut] + [x.shape[1]])

    def nearest_lists(self, x: np.ndarray, most: int) -> np.ndarray:
        """Up to ``most`` nearest lists of the TOPS nearest tops for each unit vector, nearest first; -1 where there are no more."""
        widest = int(np.diff(self.first).max())
        out = []
        for at in range(0, len(x), 1024):
            part = x[at:at + 1024]
            near = np.argsort(_squares(part, self.tops), 1, kind="stable")[:, :TOPS]
            found = np.full((len(part), near.shape[1], widest), np.inf)
            for t in np.unique(near).tolist():
                rows, place = np.nonzero(near == t)
                a, b = self.first[t], self.first[t + 1]
                found[rows, place, :b - a] = _squares(part[rows], self.coarse[a:b])
            flat = found.reshape(len(part), -1)
            best = np.argsort(flat, 1, kind="stable")[:, :most]
            lists = self.first[near[np.arange(len(part))[:, None], best // widest]] + best % widest
            lists = np.where(np.isinf(flat[np.arange(len(part))[:, None], best]), -1, lists)
            out.append(np.pad(lists, ((0, 0), (0, most - lists.shape[1])), constant_values=-1))
        return np.concatenate(out) if out else np.empty((0, most), int)

    def top_of(self, lists: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, lists, side="right") - 1

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and error of unit vectors in their lists."""
        rest = x - self.coarse[own]
        codes = np.stack([_nearest(p, b) for p, b in zip(self._parts(rest), self.books, strict=True)], 1).astype(np.uint8)
        shown = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.sqrt(((rest - shown) ** 2).sum(1))

    def tables(self, x: np.ndarray, list_: int) -> list[np.ndarray]:
        """Per subspace the squared distance of each query's rest to each code."""
        return [_squares(p, b).astype(np.float32) for p, b in zip(self._parts(x - self.coarse[list_]), self.books, strict=True)]


def compare_blocks(index: Index, queries: pd.DataFrame, members: pd.DataFrame, least: float) -> pd.DataFrame:
    """node, links, root: partners of each query among the members of the lists it probes, counted with their copies,
    and a root for every query or member with a partner; equal roots are connected here.

    A member gets the count of a query that it does not probe itself."""
    empty = pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
    if queries.empty or members.empty:
        return empty
    x, y = unit(np.stack(queries["embedding"])), unit(np.stack(members["embedding"]))
    q, m, q_copies, m_copies = (c.to_numpy(np.int64) for c in (queries["node"], members["node"], queries["copies"], members["copies"]))
    q_list, m_list = queries["list"].to_numpy(), members["list"].to_numpy()
    asked, answers = (np.stack(c) for c in (queries["probes"], members["probes"]))
    codes = np.stack([np.frombuffer(c, np.uint8) for c in members["codes"]])
    most = (math.sqrt(2 - 2 * least) + members["error"].to_numpy() + SLACK) ** 2
    q_links, m_links = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
    first, piece, touched = np.full(len(q), -1), np.arange(len(m)), np.zeros(len(m), bool)
    for list_ in np.unique(m_list).tolist():
        inside, asking = np.flatnonzero(m_list == list_), np.flatnonzero((asked == list_).any(1))
        for at in range(0, len(asking), 256):
            part = asking[at:at + 256]
            far = sum(t[:, codes[inside, i]] for i, t in enumerate(index.tables(x[part], list_)))
            near = (far <= most[inside][None, :] * (1 + 1e-4)) & (q[part, None] != m[inside][None, :])
            columns = inside[near.any(0)]
            if not len(columns):
                continue
            hit = near[:, near.any(0)] & (x[part] @ y[columns].T >= least)
            q_links[part] += hit @ m_copies[columns]
            rows, found = np.nonzero(hit)
            unseen = ~(answers[columns[found]] == q_list[part[rows]][:, None]).any(1)
            np.add.at(m_links, columns[found[unseen]], q_copies[part[rows[unseen]]])
            for i in np.flatnonzero(hit.any(1)):
                partners = columns[hit[i]]
                touched[partners] = True
                if first[part[i]] >= 0:
                    partners = np.append(partners, first[part[i]])
                pieces = np.unique(piece[partners])
                if len(pieces) > 1:
                    piece[np.isin(piece, pieces)] = pieces[0]
                first[part[i]] = partners[0]
    got = first >= 0
    return pd.DataFrame({
        "node": np.concatenate([q[got], m[touched]]), "links": np.concatenate([q_links[got], m_links[touched]]),
        "root": np.concatenate([m[piece[first[got]]], m[piece[touched]]])})


def _usable(e: Column) -> Column:
    """Neither null nor zero, all components finite."""
    odd = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & ~odd & F.exists(e, lambda v: v != 0)


def _near_of_length(nodes: DataFrame, least: float) -> DataFrame:
    """(node, links, component) of stored nodes (node, copies, embedding) of one length; links to other nodes alone."""
    spark = nodes.sparkSession
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("k1", "k2"), "node").limit(SAMPLE).select("embedding").toPandas()  # SAMPLE vectors
    shared = spark.sparkContext.broadcast(
        Index.fit(np.stack(sample["embedding"]), min(MOST_LISTS, max(1, n // PER_LIST))))  # MOST_LISTS centroids

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            if batch.empty:
                continue
            x = unit(np.stack(batch["embedding"]))
            probes = index.nearest_lists(x, PROBES)
            own = probes[:, 0]
            codes, error = index.encode(x, own)
            yield pd.DataFrame({
                "node": batch["node"], "copies": batch["copies"], "embedding": batch["embedding"], "list": own, "top": index.top_of(own),
                "codes": [c.tobytes() for c in codes], "error": error, "probes": list(probes),
                "tops": [np.unique(index.top_of(p[p >= 0])) for p in probes]})

    kind = dict(nodes.dtypes)["embedding"]
    placed = store(nodes.select("node", "copies", "embedding").mapInPandas(
        place, f"node bigint, copies bigint, embedding {kind}, list int, top int, codes binary, error double, probes array<int>, tops array<int>"))
    names = ("node", "copies", "embedding", "list", "probes")
    asked = placed.select(*[F.col(n).alias(n) for n in names], F.explode("tops").alias("top"))  # aliased: both sides come from one table
    blocks: dict[int, dict[str, int]] = {}
    for name, side in (("held", placed), ("asked", asked)):
        for r in side.groupBy("top").count().collect():  # sqrt(MOST_LISTS) rows
            blocks.setdefault(r["top"], {"held": 0, "asked": 0})[name] = -(-r["count"] // BLOCK)
    table = inline_table(spark, [{"top": k, **v} for k, v in blocks.items()], "top int, held int, asked int")

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    cut = table.where("held > 0 and asked > 0")
    members = placed.join(F.broadcast(cut), "top").select(  # a row per top
        "top", block("held").alias("a"), every("asked").alias("b"), "node", "copies", "embedding", "list", "codes", "error", "probes")
    queries = asked.join(F.broadcast(cut), "top").select(
        "top", every("held").alias("a"), block("asked").alias("b"), "node", "copies", "embedding", "list", "probes")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return compare_blocks(shared.value, left, right, least)

    grouped = queries.groupBy("top", "a", "b").cogroup(members.groupBy("top", "a", "b"))
    found = store(grouped.applyInPandas(compare, "node bigint, links bigint, root bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    pieces = components(found.select("node", "root"), "node", "root").withColumnRenamed("node", "own")
    return store(counts.join(pieces, F.col("node") == F.col("own"), "left").select("node", "links", "component"))


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links counts the other vectors found at cosine ``least`` or more, component_id is the least id
    that links reach. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do rows without an id. Vectors of different lengths have no cosine and do
    not link; each length has an index of its own. Rows that repeat an id are vectors of their own. Extra columns are left out.
    """
    e = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), e)
    rows = rows.withColumn("usable", F.coalesce(_usable(e) & F.col("vec_id").isNotNull(), F.lit(False)))
    rows = rows.withColumn("k1", F.xxhash64(F.lit(1), e)).withColumn("k2", F.xxhash64(F.lit(2), e))
    nodes = store(rows.where("usable").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    lengths = sorted(r["d"] for r in nodes.select(F.size("embedding").alias("d")).distinct().collect())  # one length in a sound table
    known = nodes.select("node", "copies", F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    parts = [_near_of_length(nodes.where(F.size("embedding") == d), least) for d in lengths]
    if parts:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        known = known.join(found, "node", "left")
    else:
        known = known.withColumns({"links": F.lit(0), "component": F.col("node")})
    known = store(known.select(
        "n1", "n2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")))
    joined = rows.select("vec_id", "k1", "k2", "usable").join(
        known, F.col("usable") & (F.col("k1") == F.col("n1")) & (F.col("k2") == F.col("n2")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

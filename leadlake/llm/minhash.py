"""Near-duplicate documents by DartMinHash over weighted five-word shingles.

A document is a weighted set: its shingles of ``SHINGLE`` words with the times each occurs.
Darts fall on each shingle's axis of weight as a Poisson process in time, by hashes of the
shingle alone, so equal shingles of two documents see equal darts. A dart counts where its
weight is below the shingle's; it also names one of ``K`` coordinates, and the earliest dart
of each coordinate is that part of the signature. Two signatures agree in a coordinate with
the probability of the weighted Jaccard similarity. Only about K ln K + 2K darts are thrown
per document, in time up to a horizon set by its total weight; a document that leaves a
coordinate empty throws on to a horizon twice as late.

Bands of ``ROWS`` coordinates join candidates: a pair at similarity 0.8 is missed with
probability (1 - 0.8^4)^24, 3 in a million. Every reported link has passed the exact weighted Jaccard.

At scale. Texts are sketched where they lie; equal texts are one node from then on. A bucket of
a band is compared as a star around its first member, so candidates grow with members, not
with their pairs. Buckets that still hold several classes after that can hide a link between
two members that are both unlike the leader. Documents that such buckets connect form a
family; its documents are compared across classes in blocks, exactly and inside the tasks,
which give back only the links that join classes. So no link is lost to the star, and no
table of pairs is made. Texts are shuffled once, for those that have a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import WORD, lean
from leadlake.llm.graph import components
from leadlake.session import store

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
BLOCK = 2_000  # documents of a family that a task compares with as many others

_WORD = re.compile(WORD)
#: Separators to str.split but not of words here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _WordHashes()


def _forget() -> None:
    _hashes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, times) of the distinct shingles, by hash.

    A text of one to four words has one shingle of all its words; no words give none.
    """
    words = _WORD.findall(text) if _ODD.search(text) else text.split()
    if len(_hashes) > 200_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    if not width:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = len(h) - width + 1
    rolled = np.full(n, width, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    return np.unique(mix(rolled), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of the lesser weights over sum of the greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    every = int(a[1].sum() + b[1].sum()) - both
    return both / every if every else 0.0


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, until: np.ndarray, first: np.ndarray, dart: np.ndarray) -> None:
    """Throws the darts of all elements up to their document's horizon.

    first, dart: the earliest time and the dart of each (document, coordinate), updated. The
    weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8), ...: a heavy element costs the
    logarithm of its weight in regions, and the darts that fall beyond its weight miss.
    """
    region, low, width = 0, 0.0, 1.0
    while len(doc):
        at, h = np.zeros(len(doc)), mix(element + np.uint64((region + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        d, w, end = doc, weight, until[doc]
        while len(d):
            h = mix(h + np.uint64(0x9E3779B97F4A7C15))
            at = at - np.log(_uniform(h)) / width
            on = at < end
            d, w, end, at, h = d[on], w[on], end[on], at[on], h[on]
            name = mix(h ^ np.uint64(0xA0761D6478BD642F))
            hit = low + width * _uniform(name) < w
            thrown = mix(name[hit])
            place = d[hit] * K + (thrown % np.uint64(K)).astype(np.int64)
            np.minimum.at(first, place, at[hit])
            best = at[hit] == first[place]
            dart[place[best]] = thrown[best]
        region, low, width = region + 1, low + width, max(1.0, low + width)
        more = weight > low
        doc, element, weight = doc[more], element[more], weight[more]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row of K darts per weighted set; zeros for an empty one."""
    n = len(sets)
    sizes = np.array([len(s[0]) for s in sets], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    element = np.concatenate([s[0] for s in sets]) if n else np.empty(0, np.uint64)
    weight = np.concatenate([s[1] for s in sets]).astype(np.float64) if n else np.empty(0)
    total = np.bincount(doc, weight, minlength=n)
    until = DARTS / np.maximum(total, 1e-300)
    first, dart = np.full(n * K, np.inf), np.zeros(n * K, np.uint64)
    todo = sizes > 0
    while todo.any():
        own = todo[doc]
        _throw(doc[own], element[own], weight[own], until, first, dart)
        todo &= np.isinf(first.reshape(n, K)).any(1)
        until = np.where(todo, 2 * until, until)
    return dart.reshape(n, K)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """A row of BANDS hashes per signature."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return h


def _parts(texts: Iterable[str], most: int = 1_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and bands for each row.

    A text without words has no bands.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = []
            for part in _parts(x or "" for x in batch.column(2).to_pylist()):
                sets = [shingles(t) for t in part]
                hashed = band_hashes(signatures(sets)).view(np.int64)
                bands += [hashed[i] if len(s[0]) else [] for i, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key_of(F.col("text")).alias("key"), "text")
    return chosen.mapInArrow(lean(run, _forget), "doc_id bigint, key string, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a weighted Jaccard of LEAST or more.

    ``texts`` has one row (id, text) for each id. One id may stand in very many pairs: both
    sides of each join are plain shuffles, which adaptive execution splits.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, tuple] = {}
        for batch in batches:
            good = []
            a, b, ta, tb = (batch.column(n).to_pylist() for n in ("a", "b", "ta", "tb"))
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if len(last) > 64:
                    last.clear()
                for node, text in ((x, ta[i]), (y, tb[i])):
                    if node not in last:
                        last[node] = shingles(text)
                if similarity(last[x], last[y]) >= LEAST:
                    good.append(i)
            yield pa.RecordBatch.from_pydict({"a": [a[i] for i in good], "b": [b[i] for i in good]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a").mapInArrow(lean(run, _forget), "a bigint, b bigint")


def _items(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(document, item) of all weighted sets as plain ones: the k-th copy of a shingle is an item
    of its own, so common items count the lesser weights."""
    doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    h = np.concatenate([s[0] for s in sets])
    times = np.concatenate([s[1] for s in sets])
    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(doc, times), mix(np.repeat(h, times) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class _Postings:
    """The documents of each item, for those documents that ``chosen`` marks."""

    def __init__(self, doc: np.ndarray, item: np.ndarray, chosen: np.ndarray, n_items: int) -> None:
        own = chosen[doc]
        doc, item = doc[own], item[own]
        self.docs = doc[np.argsort(item, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=n_items))])

    def common(self, items: np.ndarray, n: int) -> np.ndarray:
        """How many of ``items`` each document has."""
        start = self.ends[items]
        size = self.ends[items + 1] - start
        at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.docs[at], minlength=n)


def family_links(ids: np.ndarray, classes: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links at LEAST or more between documents of ``left`` and ``right`` (marks over all) that
    join two classes; one for each joining, whatever the number of links.

    Documents of the most common class meet only the others.
    """
    doc, item = _items(sets)
    _, item = np.unique(item, return_inverse=True)
    n_items, n = int(item.max(initial=-1)) + 1, len(ids)
    size = np.bincount(doc, minlength=n)
    names, label, many = np.unique(classes, return_inverse=True, return_counts=True)
    usual = int(many.argmax())
    every = _Postings(doc, item, right, n_items)
    others = _Postings(doc, item, right & (label != usual), n_items)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ends = np.concatenate([[0], np.cumsum(size)])
    out = []
    for i in np.flatnonzero(left).tolist():
        both = (others if label[i] == usual else every).common(item[ends[i]:ends[i + 1]], n)
        near = (both > 0) & (both / np.maximum(size + size[i] - both, 1) >= LEAST) & (label != label[i])
        for j in np.flatnonzero(near).tolist():
            x, y = root(label[i]), root(label[j])
            if x != y:
                parent[x] = y
                out.append((int(ids[i]), int(ids[j])))
    return out


class _Buckets:
    """Members of the band buckets, and the comparisons inside them."""

    def __init__(self, nodes: DataFrame) -> None:
        every = nodes.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
        many = store(every.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader")).where("n > 1"))
        self.members = store(every.join(many, ["band", "bucket"]).select("band", "bucket", "n", "doc_id", "leader"))

    def star(self) -> DataFrame:
        """Pairs of each member and its bucket's leader."""
        return self.members.where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()

    def families(self, classes: DataFrame | None) -> DataFrame:
        """(doc_id, class, family) of the documents in buckets that hold several classes.

        A bucket of two is settled: its star was its only pair.
        """
        large = self.members.where("n > 2")
        if classes is None:
            labelled = large.withColumn("class", F.col("doc_id"))
        else:
            labelled = store(large.join(classes, large["doc_id"] == classes["node"], "left").withColumn("class", F.coalesce("component", "doc_id")))
        several = labelled.groupBy("band", "bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
        several = store(several.where("low < high").select("band", "bucket"))
        mixed = store(labelled.join(several, ["band", "bucket"]).select("doc_id", "leader", "class"))
        families = store(components(mixed, "doc_id", "leader"))
        documents = store(mixed.select("doc_id", "class").distinct())
        return documents.join(families, documents["doc_id"] == families["node"]).select("doc_id", "class", F.col("component").alias("family"))

    @staticmethod
    def across(families: DataFrame, texts: DataFrame) -> DataFrame:
        """Links (a, b) that join classes inside the families, which are compared block by block."""
        families = store(families)
        sizes = store(families.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        placed = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
            F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
        rows = placed.join(texts, placed["doc_id"] == texts["id"]).select("family", F.inline(pair), "block", "doc_id", "class", "text")

        def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            ids, block = group["doc_id"].to_numpy(np.int64), group["block"].to_numpy()
            sets = [shingles(t) for t in group["text"]]
            found = family_links(ids, group["class"].to_numpy(np.int64), sets, block == key[1], block == key[2])
            _hashes.clear()
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        return rows.groupBy("family", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def key_of(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, key (of the text), class_id, kept; see ``near_classes``."""
    rows = store(sketch(docs))
    groups = rows.where("size(bands) > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")).where("least is not null")
    # A text's number is its least id; texts that share that with another get a negative number from their key.
    first = groups.groupBy("least").agg(F.min("key").alias("own"))
    number = F.when(F.col("key") == F.col("own"), F.col("least")).otherwise(F.shiftrightunsigned(F.xxhash64("key"), 2) - F.lit(1 << 62))
    groups = store(groups.join(first, "least").select("key", "least", number.alias("node"), "bands"))
    buckets = _Buckets(groups.select(F.col("node").alias("doc_id"), "bands"))
    ids = buckets.members.select(F.col("doc_id").alias("id")).distinct()
    wanted = store(ids.join(groups.select("node", F.col("key").alias("wanted"), F.col("least").alias("holder")), F.col("id") == F.col("node")).select("id", "wanted", "holder"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("of"), "text", key_of(F.col("text")).alias("key")).where("text is not null")
    texts = texts.join(wanted, (F.col("of") == F.col("holder")) & (F.col("key") == F.col("wanted")))
    texts = store(texts.select("id", "text").dropDuplicates(["id"]))
    classes = None
    for links in (lambda: verified(buckets.star(), texts), lambda: buckets.across(buckets.families(classes), texts)):
        found = store(links())
        if not found.isEmpty():
            # the classes so far stand for their links
            known = found if classes is None else found.unionByName(classes.select(F.col("node").alias("a"), F.col("component").alias("b")))
            classes = store(components(known, "a", "b"))
    of = groups.select("key", "least", "node")
    of = of.withColumn("component", F.col("node")) if classes is None else of.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = of.groupBy("component").agg(F.min(F.struct("least", "key")).alias("best"))
    of = store(of.join(best, "component").select("key", F.col("best.least").alias("class_id"), F.col("best.key").alias("class_key")))
    found = rows.select("doc_id", "key").join(of, "key", "left")
    chosen = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))
    return found.select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(chosen, F.lit(True)).alias("kept"))


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id, kept.

    A class is what links of similarity LEAST or more connect, equal texts included; its id is
    its least doc_id, and the row with that id is kept. A text without words, empty or null,
    is alone. Rows that repeat an id and a text are one document. Unlike texts under one id are
    told apart and may be of different classes; of those in one class the least by md5 is kept. Rows without an id have
    the class of their text, if any, and are kept. Extra columns are left out; an empty table stays empty.
    """
    return text_classes(docs).select("doc_id", "class_id", "kept")

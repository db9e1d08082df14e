"""Repeated passages: every byte covered by a LENGTH-byte string that starts anywhere else too.

The work is cut so that equal strings meet. Each document's bytes get hashes of all runs of
GRAM bytes; each start of a LENGTH-byte string is served by the anchor, the run with the
least hash inside it. Equal strings have equal anchors, at the same distance. Only anchors
whose hash occurs twice go on, each with the bytes its starts can reach (its context).

The contexts of one anchor hash are sorted as suffixes: prefix polynomial hashes make any two
stretches comparable, and binary search finds where two suffixes part. The sort compares all
suffixes of a run with one of them; side, extension and next unit order them. Neighbours in that order whose common
extension reaches LENGTH bytes are repeats, and each is verified byte for byte, in stretches of
consecutive starts, so a collision of prefix hashes removes nothing. Copies are one row there: whole texts that are
equal by their 128-bit md5, and contexts that are equal by 128 bits of hash (64 of the anchor, 64
of the context). A passage that a third of all rows share is one row, summed per task
first; copies are recognised by these 128 bits alone, not by their bytes.

An anchor with more than TOGETHER different contexts is split: blocks of BLOCK starts, counted from the anchor,
get what all their strings share as a new anchor, and take the same way once more. A block that still
has too many is split by whole strings, so that only equal strings still meet.

All of this counts in units, which a law names: bytes (``BYTES``), or words (``PASSAGES``: every
word covered by a run of 51 words that occurs anywhere else too, whatever space is between the
words). Words are handled as 64-bit numbers, hashes of those over eight bytes; the verification compares their bytes.
Several laws are served by one pass over the texts and the same shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import lean, partitions
from leadlake.llm.minhash import mix
from leadlake.session import store

LENGTH, GRAM = 400, 128
TOGETHER = 1_000  # different contexts of an anchor that one task sorts
BLOCK = 16  # starts of a large anchor that stay together at first
AT_ONCE = 500_000  # units hashed together
SUFFIXES_AT_ONCE = 200_000


@dataclass(frozen=True)
class Law:
    """What a repeated string is: ``length`` units or more; an anchor is a run of ``gram`` units."""

    length: int
    gram: int
    words: bool = False  # units are words, not bytes


BYTES = Law(LENGTH, GRAM)
PASSAGES = Law(51, 20, words=True)
BOTH = (BYTES, PASSAGES)

def _forget() -> None:
    _powers.clear()


def _edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (as in common.WORD, on its bytes; bytes.split() cuts at the same places) begin and end."""
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 32) | (data - np.uint8(9) < 5)
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


_SIZE = np.uint64(0x9E3779B97F4A7C15)


def _numbers(text: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word: its bytes, scrambled with its size, or the hash of a word of more than eight bytes."""
    data, size = np.frombuffer(text, np.uint8), end - begin
    packed = np.zeros(len(begin), np.uint64)
    for i in range(8):
        longer = np.flatnonzero(size > i)
        packed[longer] |= data[begin[longer] + i].astype(np.uint64) << np.uint64(8 * i)
    out = mix(packed) + size.astype(np.uint64) * _SIZE
    many = np.flatnonzero(size > 8)
    out[many] = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin[many].tolist(), end[many].tolist(), strict=True)]
    return out


def units(texts: Sequence[bytes], law: Law) -> list[np.ndarray]:
    """Texts as arrays of numbers: their bytes, or their words."""
    if not law.words:
        return [np.frombuffer(text, np.uint8) for text in texts]
    joined = b" ".join(texts)
    begin, end = _edges(joined)
    after = np.cumsum([len(text) + 1 for text in texts[:-1]])
    return np.split(_numbers(joined, begin, end), np.searchsorted(begin, after)) if len(texts) else []


def _bounds(text: bytes, n: int, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings of ``law.length`` units that start at each of n units begin and end, in bytes."""
    if not law.words:
        return np.arange(n), np.arange(n) + law.length
    begin, end = _edges(text)
    return begin[:n], end[law.length - 1:law.length - 1 + n]


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


class PrefixHashes:
    """Hashes of any stretch of a byte buffer, from sums over its prefixes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def runs(self, length: int) -> np.ndarray:
        """Of every stretch of one length, scrambled."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n])

    def common(self, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
        """How many bytes from x and from y on agree, up to ``limit``, by binary search."""
        low = np.zeros(len(x), np.int64)
        same = self.of(x, limit) == self.of(y, limit)
        low[same] = limit
        part = np.flatnonzero(~same)
        x, y = x[part], y[part]
        from_x, from_y, over_x, over_y = self.sums[x], self.sums[y], self.inverse[x], self.inverse[y]
        a, b = low[part], np.full(len(part), limit, np.int64)  # agree up to a, not up to b
        for _ in range(int(limit).bit_length()):
            middle = (a + b) >> 1
            equal = (self.sums[x + middle] - from_x) * over_x == (self.sums[y + middle] - from_y) * over_y
            a, b = np.where(equal, middle, a), np.where(equal, b, middle)
        low[part] = np.minimum(a, limit - 1)
        return low


def _least_run(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` hashes the place of the least; the first of equal ones.

    The low bits of a hash give way to its place, so the order is by the high 40 bits.
    """
    n = len(hashes)
    tagged = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    padded = np.concatenate([tagged, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(texts: Sequence[bytes | np.ndarray], law: Law = BYTES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (its bytes or units): the hash of each anchor, the last start it serves, and a 64-bit key of its context.

    An anchor serves the starts after those of the anchor before it; its context reaches from
    its first start to the law's length from its last one.
    """
    none = np.empty(0, np.int64)
    out = [(none, none, none)] * len(texts)
    group, size = [], 0
    for i, text in enumerate(texts):
        if len(text) >= law.length:
            group.append(i)
            size += len(text)
        if group and (size >= AT_ONCE or i == len(texts) - 1 or size + len(texts[i + 1]) > 2 * AT_ONCE):
            data = np.concatenate([_array(texts[j]) for j in group])
            if len(group) == 1 and len(data) > 2 * AT_ONCE:  # one huge text: in overlapping parts
                out[group[0]] = _huge(data, law)
            else:
                for j, found in zip(group, _anchors(data, [len(texts[j]) for j in group], law), strict=True):
                    out[j] = found
            group, size = [], 0
    return out


def _array(text: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text


def _anchors(data: np.ndarray, sizes: list[int], law: Law = BYTES) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    hashes = PrefixHashes(data).runs(law.gram)
    least = _least_run(hashes, law.length - law.gram + 1)
    view, out, base = memoryview(data), [], 0
    for size in sizes:
        places = least[base:base + size - law.length + 1]
        ends = np.flatnonzero(np.append(places[1:] != places[:-1], True))
        first = base + np.concatenate([[0], ends[:-1] + 1])
        keys = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (base + ends + law.length).tolist(), strict=True)]
        out.append((hashes[places[ends]].view(np.int64), ends, np.array(keys, np.uint64).view(np.int64)))
        base += size
    return out


def _huge(data: bytes | np.ndarray, law: Law = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = AT_ONCE
    parts = []
    for base in range(0, len(data) - law.length + 1, step):
        piece = _array(data[base:base + step + law.length - 1])
        hashes, last, keys = _anchors(piece, [len(piece)], law)[0]
        parts.append((hashes, last + base, keys))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_order(prefix: PrefixHashes, data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """The order of the suffixes at ``starts``, cut at ``limit`` units, inside each group; equal ones stay in their order."""
    return _suffix_order(prefix, data, starts, group, limit)[0]


def _suffix_order(prefix: PrefixHashes, data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_order``, and for each place of it whether the suffix there agrees with the one before up to the limit.

    Suffixes are first told apart by their group and first eight bytes, or first word. Then, for all runs of those that tie
    at once, each suffix of a run is compared with the run's middle one, by the search for their common extension: those that
    part from it to the smaller side go before it, the sooner the earlier, those that part to the larger side behind it, the
    sooner the later. What parts at the same place with the same unit is a run again.
    """
    if data.dtype == np.uint64:
        head = data[starts]
    else:
        head = np.zeros(len(starts), np.uint64)
        for i in range(8):
            head = (head << np.uint64(8)) | data[starts + i].astype(np.uint64)
    order = np.lexsort((head, group))
    g, h = group[order], head[order]
    run = np.cumsum(np.append(False, (g[1:] != g[:-1]) | (h[1:] != h[:-1])))[:len(order)]
    same = np.zeros(len(order), bool)
    at = np.arange(len(order))
    while True:
        sizes = np.bincount(run) if len(run) else np.empty(0, np.int64)
        tied = sizes[run] > 1
        at, run = at[tied], run[tied]
        if not len(at):
            return order, same
        sizes = sizes[sizes > 1]
        first = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(sizes)), sizes)
        y = starts[order[at]]
        x = y[np.repeat(first + sizes // 2, sizes)]
        common = prefix.common(x, y, limit)
        cut = np.minimum(common, limit - 1)
        unit, pivot = data[y + cut], data[x + cut]
        equal = common >= limit
        key = np.where(equal, limit, np.where(unit < pivot, common, 2 * limit - common))
        unit = np.where(equal, 0, unit)
        key = run * (2 * limit + 1) + key
        new = np.lexsort((unit, key)) if data.dtype == np.uint64 else np.argsort(key * 256 + unit, kind="stable")
        order[at] = order[at][new]
        key, unit, equal = key[new], unit[new], equal[new]
        again = np.append(False, (key[1:] == key[:-1]) & (unit[1:] == unit[:-1]))
        same[at[again & equal]] = True
        left = ~equal  # the others are in their places
        at, run = at[left], np.cumsum(~again)[left]


def _equal_pairs(text: bytes, begin: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the bytes of a text between begin[x] and end[x] are those between begin[y] and end[y].

    ``begin`` and ``end`` ascend. Pairs at one distance whose strings touch or overlap are compared in one stretch,
    and one by one where that differs.
    """
    order = np.lexsort((x, y - x))
    a, b = x[order], y[order]
    fresh = np.append(True, (b[1:] - a[1:] != b[:-1] - a[:-1]) | (begin[a[1:]] > end[a[:-1]]))[:len(a)]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(a))[:len(first)] - 1
    places = (begin[a[first]], end[a[last]], begin[b[first]], end[b[last]])
    equal = np.array([text[p:q] == text[r:s] for p, q, r, s in zip(*(v.tolist() for v in places), strict=True)], bool)
    equal = np.repeat(equal, last - first + 1)
    for i in np.flatnonzero(~equal).tolist():
        equal[i] = text[begin[a[i]]:end[a[i]]] == text[begin[b[i]]:end[b[i]]]
    out = np.empty(len(x), bool)
    out[order] = equal
    return out


def repeated_starts(contexts: list[bytes], group: np.ndarray, length: int = LENGTH, words: bool = False) -> list[np.ndarray]:
    """Per context a mark for each of its starts: whether the string there starts in another
    place of the same group's contexts too."""
    marks, many = _repeated(contexts, group, Law(length, 0, words))
    return np.split(marks, np.cumsum(many)[:-1]) if len(contexts) else []


def _repeated(contexts: list[bytes], group: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """The marks of ``repeated_starts`` in one array, and how many each context has."""
    length = law.length
    text = (b" " if law.words else b"").join(contexts)
    if law.words:
        begin, end = _edges(text)
        data = _numbers(text, begin, end)
        past = np.cumsum([len(c) + 1 for c in contexts])  # where the next context begins
        sizes = np.diff(np.searchsorted(begin, past), prepend=0)
    else:
        data = np.frombuffer(text, np.uint8)
        begin, end = np.arange(len(data)), np.arange(1, len(data) + 1)
        sizes = np.array([len(c) for c in contexts], np.int64)
    many = np.maximum(sizes - length + 1, 0)
    base = np.cumsum(sizes) - sizes
    starts = np.repeat(base - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    marks = np.zeros(len(starts), bool)
    order, same = _suffix_order(PrefixHashes(data), data, starts, np.repeat(group, many), length)
    near = np.flatnonzero(same)
    x, y = order[near - 1], order[near]
    near = _equal_pairs(text, begin, end[length - 1:], starts[x], starts[y])
    marks[x[near]] = marks[y[near]] = True
    return marks, many


def _runs(marks: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of marks inside each context of ``many`` marks: the context, and the run's first and last place there."""
    own = np.repeat(np.arange(len(many)), many)
    fresh = np.append(True, own[1:] != own[:-1])[:len(own)]
    first = np.flatnonzero(marks & (fresh | ~np.append(False, marks[:-1])[:len(own)]))
    last = np.flatnonzero(marks & (np.append(fresh[1:], True) | ~np.append(marks[1:], False))[:len(own)])
    base = (np.cumsum(many) - many)[own[first]]
    return own[first], first - base, last - base


def _parts(texts: list[bytes], most: int = 8 * AT_ONCE) -> Iterator[slice]:
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


ANCHORS = "law tinyint, anchor bigint, context bigint, first int, last int"


def _served(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """anchor, context, first and last start of each anchor of a text."""
    hashes, last, keys = found
    return hashes, keys, np.concatenate([[-1], last[:-1]])[:len(last)] + 1, last


def scan(docs: DataFrame, laws: Sequence[Law] = BOTH) -> DataFrame:
    """Per row: doc_id, key (md5 of the text), for each law whether the text is as long as its strings, and the anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, ids = _bytes_of(batch.column(1)), batch.column(0)
            for part in _parts(every):
                texts = every[part]
                long, columns = [], [[] for _ in texts]
                for number, law in enumerate(laws):
                    counted = units(texts, law)
                    long.append([len(u) >= law.length for u in counted])
                    for i, found in enumerate(anchors(counted, law)):
                        columns[i].append((np.full(len(found[0]), number, np.int8), *_served(found)))
                joined = [[np.concatenate(c) for c in zip(*parts, strict=True)] for parts in columns]
                kinds = (pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    ids[part.start:part.stop], pa.array([hashlib.md5(t).digest() for t in texts], pa.binary()),
                    pa.array([list(x) for x in zip(*long, strict=True)], pa.list_(pa.bool_())),
                    *[pa.array([j[k].astype(t.to_pandas_dtype()) for j in joined], pa.list_(t)) for k, t in enumerate(kinds)],
                ], names=["doc_id", "key", "long", "law", "anchor", "context", "first", "last"])

    schema = ("doc_id bigint, key binary, long array<boolean>, law array<tinyint>, anchor array<bigint>, context array<bigint>, "
              "first array<int>, last array<int>")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lean(run, _forget), schema)


def _slices(texts: DataFrame, wanted: DataFrame, laws: Sequence[Law]) -> DataFrame:
    """The bytes of the wanted contexts: key, law, anchor, first, bytes."""
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("law", "anchor", "first", "last")).alias("cuts"))  # one text's anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), _bytes_of(batch.column(1))
            for key, text, cuts in zip(keys, texts, batch.column(2).to_pylist(), strict=True):
                words = text.split() if any(laws[c["law"]].words for c in cuts) else []
                parts = []
                for c in cuts:
                    law = laws[c["law"]]
                    a, b = c["first"], c["last"] + law.length
                    parts.append(b" ".join(words[a:b]) if law.words else text[a:b])
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(cuts), pa.binary()), pa.array([c["law"] for c in cuts], pa.int8()),
                    pa.array([c["anchor"] for c in cuts], pa.int64()), pa.array([c["first"] for c in cuts], pa.int32()),
                    pa.array(parts, pa.binary()),
                ], names=["key", "law", "anchor", "first", "bytes"])

    return texts.join(per_text, "key").select("key", "text", "cuts").mapInArrow(
        lean(run, _forget), "key binary, law tinyint, anchor bigint, first int, bytes binary")


SPANS = "key binary, law tinyint, from bigint, until bigint"


def _sorted_repeats(slices: DataFrame, laws: Sequence[Law]) -> DataFrame:
    """Spans of the repeats among the contexts of each anchor hash."""
    schema = pa.schema([("key", pa.binary()), ("law", pa.int8()), ("from", pa.int64()), ("until", pa.int64())])

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        number = rows[0][1]
        law = laws[number]
        _, group = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
        which, a, b = _runs(*_repeated([r[4] for r in rows], group, law))
        first = np.array([r[3] for r in rows], np.int64)[which]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in which.tolist()], pa.binary()), pa.array(np.full(len(which), number), pa.int8()),
            pa.array(first + a), pa.array(first + b + law.length),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # whole anchors of one law, then the anchor that may go on in the next row
        size, group = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[1:3] != group:
                    if waiting and (size >= SUFFIXES_AT_ONCE or row[1] != group[0]):
                        yield spans(waiting)
                        waiting, size = [], 0
                    group = row[1:3]
                waiting.append(row)
                size += (row[4].count(b" ") + 1 if laws[row[1]].words else len(row[4])) - laws[row[1]].length + 1
        if waiting:
            yield spans(waiting)

    spark = slices.sparkSession
    order = ["law", "anchor", "key", "first"]
    sorted_slices = slices.repartition(partitions(spark), "law", "anchor").sortWithinPartitions(*order)
    return sorted_slices.select("key", "law", "anchor", "first", "bytes").mapInArrow(lean(run, _forget), SPANS)


def _blocks(data: np.ndarray, law: Law, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last start of each block of a context's starts, and the hash of what all strings of the whole block share.

    Equal strings have the anchor at one distance, so they are in blocks of one number, and at one place there.
    """
    starts = len(data) - law.length + 1
    prefix = PrefixHashes(data)
    if block == 1:
        return np.arange(starts), np.arange(starts), prefix.runs(law.length)
    place = int(_least_run(prefix.runs(law.gram)[:law.length - law.gram + 1], law.length - law.gram + 1)[0])
    least = place - np.arange((place - starts + 1) // block, place // block + 1)[::-1] * block  # from here on all strings have it
    shared = mix(prefix.of(least, law.length - block + 1))
    return np.maximum(least - block + 1, 0), np.minimum(least, starts - 1), shared


def _split(slices: DataFrame, laws: Sequence[Law], block: int = 1) -> DataFrame:
    """key and ANCHORS of the starts of large anchors, in blocks by anchors of their own: what a block's strings share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, number, first, text in zip(*(batch.column(n).to_pylist() for n in ("key", "law", "first", "bytes")), strict=True):
                law = laws[number]
                data = units([text], law)[0]
                low, high, shared = _blocks(data, law, block)
                begin, end = _bounds(text, len(data) - law.length + 1, law)
                whole = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin[low].tolist(), end[high].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([key] * len(low), pa.binary()), pa.array(np.full(len(low), number), pa.int8()), pa.array(shared.view(np.int64)),
                    pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(low + first, pa.int32()), pa.array(high + first, pa.int32()),
                ], names=["key", "law", "anchor", "context", "first", "last"])

    return slices.mapInArrow(lean(run, _forget), f"key binary, {ANCHORS}")


def _meet(served: DataFrame, laws: Sequence[Law]) -> tuple[DataFrame, DataFrame]:
    """(settled, wanted) of anchors: spans of the contexts that occur twice, and one occurrence of each
    context of an anchor that has others, with m, their number."""
    again = store(served.groupBy("law", "anchor").agg(F.count("*").alias("n")).where("n > 1").select("law", "anchor"))
    served = store(served.join(again, ["law", "anchor"]))
    contexts = store(served.groupBy("law", "anchor", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("one")))
    different = store(contexts.groupBy("law", "anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1"))
    wanted = contexts.join(different, ["law", "anchor"]).select("law", "anchor", "m", "one.*")
    settled = served.join(store(contexts.where("n > 1").select("law", "anchor", "context")), ["law", "anchor", "context"])
    length = F.get(F.lit([law.length for law in laws]), F.col("law").cast("int"))
    return settled.select("key", "law", F.col("first").cast("bigint").alias("from"), (F.col("last") + length).cast("bigint").alias("until")), wanted


@dataclass(frozen=True)
class Repeats:
    """Rows of a table of documents, and what is repeated in their texts.

    rows: row (a struct of the documents' columns but text), text, key, and whether anything of it may be repeated.
    whole: key and, per law, whether it takes all of a text that occurs twice. spans: key, law, from, until, in
    units, for the other texts. texts: key and text of all texts with spans, and of some without, a row each.
    """

    rows: DataFrame
    whole: DataFrame
    spans: DataFrame
    texts: DataFrame


def repeats(docs: DataFrame, laws: Sequence[Law] = BOTH) -> Repeats:
    """Finds what each law calls repeated. Null texts are empty."""
    scanned = store(scan(docs, laws))
    copies = store(scanned.groupBy("key").agg(F.count("*").alias("n"), F.first("long").alias("long")).where("n > 1").select("key", "long"))
    # Of equal texts one serves.
    anchored = scanned.where("size(anchor) > 0").groupBy("key").agg(F.first(F.struct("law", "anchor", "context", "first", "last")).alias("a"))
    anchored = store(anchored)
    zipped = F.arrays_zip(*[F.col(f"a.{n}") for n in ("law", "anchor", "context", "first", "last")])
    served = anchored.select("key", F.explode(zipped).alias("s")).select("key", "s.*")
    settled, wanted = _meet(served, laws)
    wanted = store(wanted)
    whole = store(copies.where(F.exists("long", lambda x: x)))
    settled = store(settled.join(whole.select("key").hint("merge"), "key", "left_anti"))
    needed = store(settled.select("key").unionByName(wanted.select("key")).unionByName(whole.select("key")).distinct())

    text = F.coalesce(F.col("text"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.select(F.struct(*others).alias("row"), "text", F.unhex(F.md5(text.cast("binary"))).alias("key"))
    marked = needed.select(F.col("key").alias("found")).hint("merge")
    rows = store(keyed.join(marked, keyed["key"] == F.col("found"), "left").select("row", "text", "key", F.col("found").isNotNull().alias("touched")))
    texts = store(rows.where("touched").groupBy("key").agg(F.first("text").alias("text")))
    columns = ["key", "law", "anchor", "first", "last"]
    sorted_, large = wanted.where(F.col("m") <= TOGETHER).select(*columns), wanted.where(F.col("m") > TOGETHER).select(*columns)
    for block in (BLOCK, 1):
        if large.isEmpty():
            break
        more, rest = _meet(store(_split(_slices(texts, large, laws), laws, block)), laws)
        rest, few = store(rest), F.lit(block == 1) | (F.col("m") <= TOGETHER)
        settled, sorted_ = settled.unionByName(more), sorted_.unionByName(rest.where(few).select(*columns))
        large = rest.where(~few).select(*columns)
    return Repeats(rows, whole, store(settled.unionByName(_sorted_repeats(_slices(texts, sorted_, laws), laws))), texts)


def _merged(spans: list[dict], text: bytes, laws: Sequence[Law]) -> list[tuple[int, int]]:
    """The spans in bytes, overlapping and touching ones as one. A run of words ends with its last word."""
    places = [(s["from"], s["until"]) for s in spans if not laws[s["law"]].words]
    words = [(s["from"], s["until"] - 1) for s in spans if laws[s["law"]].words]
    if words:
        begin, end = _edges(text)
        first, last = np.array(words, np.int64).T
        places += zip(begin[first].tolist(), end[last].tolist(), strict=True)
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def cut_texts(found: Repeats, laws: Sequence[Law]) -> DataFrame:
    """For every text of ``found``: key, kept_text (what all laws leave, in whole characters), whether that
    is less than the text, and n_removed, n_spans, kept_sha256 by the first law alone."""
    per_text = found.spans.groupBy("key").agg(F.collect_list(F.struct("law", "from", "until")).alias("spans"))  # one text's spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("key", "kept_text", "changed", "n_removed", "n_spans", "kept_sha256")}
            for key, text, spans in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans = spans or []
                first = _merged([s for s in spans if s["law"] == 0], text, laws)
                kept = _kept_bytes(text, first)
                every = _kept_bytes(text, _merged(spans, text, laws)) if len(laws) > 1 else kept
                values = (key, every.decode("utf-8", "ignore"), len(every) < len(text), len(text) - len(kept), len(first),
                          hashlib.sha256(kept).hexdigest())
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("key", pa.binary()), ("kept_text", pa.string()), ("changed", pa.bool_()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                ("kept_sha256", pa.string())]))

    schema = "key binary, kept_text string, changed boolean, n_removed bigint, n_spans bigint, kept_sha256 string"
    return found.texts.join(per_text, "key", "left").select("key", "text", "spans").mapInArrow(lean(run, _forget), schema)


def _results(docs: DataFrame, laws: Sequence[Law]) -> DataFrame:
    """row, text and key of every document, with touched, whole (per law, or null) and, of touched ones, the columns of ``cut_texts``."""
    found = repeats(docs, laws)
    cut = store(cut_texts(found, laws).join(found.whole.select("key", F.col("long").alias("whole")), "key", "left"))
    touched = found.rows.where("touched").select("row", "key").join(cut.hint("merge"), "key")  # no text moves for this but the kept one
    empty = [F.lit(None).cast(t).alias(n) for n, t in cut.dtypes if n != "key"]
    plain = found.rows.where("not touched").select("key", "row", *empty, "text")
    return plain.unionByName(touched.withColumn("text", F.lit(None).cast("string")))


def digests(docs: DataFrame, laws: Sequence[Law] = BOTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 by the first law, and text, which all laws leave.

    A null text is empty. Repeated rows are documents of their own, so they repeat each other,
    whatever their ids, null ones included. Extra columns are left out; an empty table stays empty.
    ``text`` keeps whole characters; it is empty where a law takes all of a text.
    """
    sizes = docs.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint"))
    found = _results(sizes.select("doc_id", "n_bytes", "text"), laws)
    gone = F.coalesce(F.get("whole", F.lit(0)), F.lit(False))
    n_bytes, text = F.col("row.n_bytes"), F.coalesce("text", F.lit(""))
    return found.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"), n_bytes.alias("n_bytes"),
        F.when(gone, n_bytes).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.sha2(text, 256))).alias("kept_sha256"),
        F.when(_any(F.col("whole")), F.lit("")).otherwise(F.coalesce("kept_text", text)).alias("text"),
    )


def _any(flags):
    return F.coalesce(F.exists(flags, lambda x: x), F.lit(False))


def without_repeats(docs: DataFrame, laws: Sequence[Law] = BOTH) -> DataFrame:
    """The documents without what any of the laws calls repeated, in the same columns; every row stays.

    What remains of a text keeps its whole characters; a character cut inside is dropped.
    n_chars, if there, is counted anew where something was cut. Texts without repeats, null ones included, stay as they are.
    """
    found = _results(docs, laws)
    whole = _any(F.col("whole"))
    cut = whole | F.coalesce("changed", F.lit(False))
    new = F.when(whole, F.lit("")).otherwise(F.col("kept_text"))
    out = {"text": F.when(F.col("kept_text").isNotNull(), new).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out["n_chars"] = F.when(cut, F.length(new).cast(kind)).otherwise(F.col("row.n_chars"))
    return found.select(*[out[c].alias(c) if c in out else F.col("row").getField(c).alias(c) for c in docs.columns])

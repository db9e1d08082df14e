"""Packing by shortest-pack-first over the length histogram.

Documents become token ids; what is longer than a sequence is cut at its multiples. The
histogram of piece lengths (at most ``capacity`` numbers) is all that reaches the driver.
There lengths are placed longest first, each piece into the open pack with the most room,
and packs with the same room are one group with a count. A group is a range of sequence
ids, so every placement is a run (length, first rank, count) -> (first sequence id, offset),
and pieces find their place by their rank within their length. Ranks are spread over hashed
buckets, so one length may hold a third of all pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import inline_table, lean, partitions, ranked
from leadlake.llm.tokens import forget, word_encoder
from leadlake.session import store


def pack_histogram(counts: dict[int, int], capacity: int) -> list[dict]:
    """Runs of ranks per length with their sequence ids and offset.

    Groups of packs are kept by room; a group is (first id, how many). When no open pack has
    room, n pieces of one length open ceil(n / (capacity // length)) packs, which is what
    placing them one at a time would do.
    """
    by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []  # a heap of negated rooms that may be in use
    runs: list[dict] = []
    next_id = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in by_room:
                by_room[room] = []
                heapq.heappush(rooms, -room)
            by_room[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def place(first: int, n: int, offset: int, at: int, length: int = length) -> None:
            runs.append({"length": length, "first": at, "until": at + n, "sequence_base": first, "offset": offset})

        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                first, n = by_room[room].pop()
                take = min(n, left)
                if take < n:
                    by_room[room].append((first + take, n - take))
                elif not by_room[room]:
                    del by_room[room]
                    heapq.heappop(rooms)
                place(first, take, capacity - room, rank)
                put(room - length, first, take)
                rank, left = rank + take, left - take
            else:
                each = capacity // length
                full, rest = divmod(left, each)
                for i in range(each if full else 0):
                    place(next_id, full, i * length, rank)
                    rank += full
                put(capacity - each * length, next_id, full)
                next_id += full
                for i in range(rest):
                    place(next_id, 1, i * length, rank)
                    rank += 1
                if rest:
                    put(capacity - rest * length, next_id, 1)
                    next_id += 1
                left = 0
    return runs


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
])


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, with_ids: bool = False,
    id_column: str = "doc_id", text_column: str = "text", release: bool = False,
) -> DataFrame:
    """Each document as token ids and ``end_id``, cut at the multiples of ``capacity``.

    A row per piece: doc_id, start, length, ids_crc32 (of unsigned little-endian 32-bit ids),
    doc_tokens, and the ids if wanted. Null texts are empty: one piece that holds the end id.
    ``release``: a task's end frees the tokenizer's memory, so other stages of a job have it, and the next task learns its chunks anew.
    """
    schema = _PIECES if with_ids else _PIECES.remove(len(_PIECES) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            ids_of = encode(x or "" for x in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.int32(end_id))
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    row = (doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), piece)
                    for column, value in zip(out, row):  # noqa: B905  the last only with_ids
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    ddl = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(lean(run, forget) if release else run, ddl)


def pack(pieces: DataFrame, capacity: int, spread: list[str]) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    ``spread`` names columns that tell pieces apart; pieces equal in all are interchangeable.
    Sequence ids and the offsets in a sequence have no gaps. An empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = inline_table(
        spark, pack_histogram(counts, capacity),
        "length bigint, first bigint, until bigint, sequence_base bigint, offset bigint",
    )
    placed = ranked(pieces, "length", spread, spread, "rank", partitions(spark))
    same = (placed["length"] == runs["length"]) & (placed["rank"] >= runs["first"]) & (placed["rank"] < runs["until"])
    placed = placed.join(F.broadcast(runs), same).drop(runs["length"])  # bounded by capacity, not by the documents
    return (
        placed.withColumn("sequence_id", F.col("sequence_base") + F.col("rank") - F.col("first"))
        .drop("rank", "first", "until", "sequence_base")
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False, release: bool = False) -> DataFrame:
    """Token pieces of all documents with their sequences.

    Repeated rows are documents of their own, null ids included; extra columns are left out.
    The pieces are stored once, so texts are read and encoded once and never shuffled.
    """
    pieces = store(token_pieces(docs, tokenizer, capacity, end_id, with_ids, release=release))
    return pack(pieces, capacity, ["doc_id", "start", "ids_crc32", "doc_tokens"])


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the pieces with their offsets.

    Needs pieces with ids. A group is one sequence, so it is bounded by the capacity.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("pieces")).select(
        "sequence_id", F.flatten("pieces.ids").alias("ids"),
        F.transform("pieces", lambda p: F.struct(p["doc_id"], p["start"], p["length"], p["offset"])).alias("pieces"),
    )

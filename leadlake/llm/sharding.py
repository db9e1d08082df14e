"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points on a ring of 2^32 places. A document hashes to a
place and belongs to the next point clockwise. A shard takes at most its capacity; documents
that find it full go on clockwise to the next point whose shard has room. Capacities are
floor(n / shards), one more for the first n mod shards shards, so the balance is exact: row
counts differ by at most one. Compared with hashing modulo the number of shards, one more
shard moves few documents between the old ones.

At scale. Documents between two points (an arc) act alike, so only the arc counts decide who
overflows: shards x virtual_nodes numbers, whatever the number of documents. They are the
only thing that reaches the driver. It settles runs (arc, first rank, length) -> (shard,
first slot), and the documents find their run by their rank inside the arc. The rank is
spread over hashed buckets, so an arc that holds a third of all rows stays distributed. All
row work is DataFrame functions; texts are read once and never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.common import inline_table, partitions, ranked
from leadlake.session import store

RING = 1 << 32


def ring_points(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, by place: md5 of "shard:node", first 32 bits."""
    return sorted(
        (int(md5(f"{shard}:{node}".encode()).hexdigest()[:8], 16), shard)
        for shard in range(shards) for node in range(virtual_nodes)
    )


def settle(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[dict]:
    """Runs of ranks in each arc with their shard and first slot there.

    The overflow of all arcs moves clockwise in step: at step d, arc a offers what is left to
    the point a + d, in the order of the arcs. Full shards are skipped by the offer itself.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    left = {arc: n for arc, n in sorted(counts.items()) if n}
    done = dict.fromkeys(left, 0)
    runs: list[dict] = []
    step = 0
    while left:
        for arc in list(left):
            shard = points[(arc + step) % len(points)][1]
            take = min(left[arc], room[shard])
            if take:
                runs.append({"arc": arc, "first": done[arc], "until": done[arc] + take, "shard": shard, "slot_base": used[shard]})
                room[shard] -= take
                used[shard] += take
                done[arc] += take
                left[arc] -= take
                if not left[arc]:
                    del left[arc]
        step += 1
    return runs


def arc_of(place: int, points: list[tuple[int, int]]) -> int:
    """The point at or after a place, clockwise."""
    return bisect_left(points, (place, -1)) % len(points)


def shard_documents(
    docs: DataFrame, shards: int, virtual_nodes: int = 128, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    size is the UTF-8 bytes of the text plus 16. A null text counts as empty. Repeated rows
    are documents of their own; a null id hashes as the text "null". Extra columns are left
    out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    points = ring_points(shards, virtual_nodes)
    text = F.coalesce(F.col(text_column), F.lit(""))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10)
    rows = store(docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place.cast("bigint").alias("place"),
    ))
    # The points are evenly spread by hashing: look near where the place should be, by cells of
    # the ring that each hold few points.
    cells = 1 << max(1, len(points).bit_length())
    width = RING // cells
    near: dict[int, list[int]] = {c: [] for c in range(cells)}
    for place_of_point, _ in points:
        near[place_of_point // width].append(place_of_point)
    first_in = [bisect_left(points, (c * width, -1)) for c in range(cells)]
    table = inline_table(
        spark, [{"cell": c, "base": first_in[c], "inside": near[c]} for c in range(cells)],
        "cell bigint, base int, inside array<bigint>",
    )
    arcs = (
        rows.withColumn("cell", F.floor(F.col("place") / width))
        .join(F.broadcast(table), "cell")  # about two rows per point, whatever the documents
        .withColumn("arc", F.expr(f"(base + size(filter(inside, p -> p < place))) % {len(points)}"))
        .drop("cell", "base", "inside")
    )
    counts = {r["arc"]: r["n"] for r in arcs.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # one per point at most
    runs = inline_table(spark, settle(counts, points, shards), "arc int, first bigint, until bigint, shard int, slot_base bigint")
    placed = ranked(arcs, "arc", ["doc_id", "text_crc32", "size"], ["doc_id", "text_crc32", "size"], "rank", partitions(spark))
    placed = placed.join(
        F.broadcast(runs),  # a few rows per point, whatever the documents
        (placed["arc"] == runs["arc"]) & (placed["rank"] >= runs["first"]) & (placed["rank"] < runs["until"]),
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("slot_base") + F.col("rank") - F.col("first")).alias("slot"),
    )

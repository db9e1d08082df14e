import zlib
from collections import Counter
from hashlib import md5

from leadlake.llm.sharding import arc_of, ring_points, settle, shard_documents


def clockwise(arcs, points, shards):
    """Documents one at a time, step by step round the ring, in the order of the arcs."""
    total = sum(arcs.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    got, left, step = Counter(), dict(arcs), 0
    while any(left.values()):
        for a in sorted(left):
            s = points[(a + step) % len(points)][1]
            while left[a] and room[s]:
                room[s] -= 1
                left[a] -= 1
                got[a, s] += 1
        step += 1
    return got


def test_runs_are_the_walk():
    points = ring_points(5, 8)
    arcs = {a: (a * 7) % 13 for a in range(len(points))}
    runs = settle(arcs, points, 5)
    got = Counter()
    for r in runs:
        got[r["arc"], r["shard"]] += r["until"] - r["first"]
    assert got == clockwise(arcs, points, 5)


def check(docs, rows, shards):
    sized = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == sized
    counts = Counter(r.shard for r in rows)
    every = [counts.get(s, 0) for s in range(shards)]
    assert max(every) - min(every) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert set(counts) <= set(range(shards))


def test_balance_and_slots(spark, documents):
    docs = [(i, f"text {i}") for i in range(503)] + [(7, "repeat")] * 40
    rows = shard_documents(documents(*docs), 8, 16).collect()
    check(docs, rows, 8)
    points = ring_points(8, 16)
    at_home = sum(points[arc_of(int(md5(str(r.doc_id).encode()).hexdigest()[:8], 16), points)][1] == r.shard for r in rows)
    assert at_home > len(rows) / 2


def test_few_rows_move_when_a_shard_comes(spark, documents):
    docs = documents(*[(i, "x") for i in range(2000)])
    before = {r.doc_id: r.shard for r in shard_documents(docs, 10).collect()}
    after = {r.doc_id: r.shard for r in shard_documents(docs, 11).collect()}
    moved = sum(before[d] != after[d] for d in before)
    assert moved < 2000 * 0.45  # modulo would move ten elevenths


def test_odd_rows(spark, odd, documents):
    check([(r.doc_id, r.text) for r in odd.collect()], shard_documents(odd, 3, 4).collect(), 3)
    assert shard_documents(documents(), 3, 4).count() == 0

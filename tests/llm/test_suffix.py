import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from leadlake.llm import suffix as S


def brute(texts, length=S.LENGTH):
    many = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if many[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def random_bytes(rng, n):
    return bytes(rng.choice(b"abcde ") for _ in range(n))


def test_marks_and_order():
    rng = random.Random(1)
    for _ in range(20):
        base = random_bytes(rng, 300)
        contexts = [random_bytes(rng, rng.randint(0, 30)) + base[a:a + rng.randint(60, 200)] for a in (0, 20, 20, 70, 100)] + [b"ab" * 60]
        data = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.array([len(c) for c in contexts])
        starts = np.concatenate([b + np.arange(n - 59) for b, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True)])
        order = S.suffix_order(S.PrefixHashes(data), data, starts, np.zeros(len(starts), int), 60)
        cut = [data[s:s + 60].tobytes() for s in starts[order]]
        assert cut == sorted(cut)
        many = Counter(c[i:i + 60] for c in contexts for i in range(len(c) - 59))
        expected = [[many[c[i:i + 60]] > 1 for i in range(len(c) - 59)] for c in contexts]
        assert [m.tolist() for m in S.repeated_starts(contexts, np.zeros(len(contexts), int), 60)] == expected


def test_groups_do_not_meet():
    text = b"x" * 30 + b"y" * 50
    marks = S.repeated_starts([text, text], np.array([0, 1]), 60)
    assert not any(m.any() for m in marks)


def test_common_extension():
    data = np.frombuffer(b"abcdefgh" * 20 + b"abcdXfgh" * 20, np.uint8)
    assert S.PrefixHashes(data).common(np.array([0, 0, 3]), np.array([8, 160, 163]), 100).tolist() == [100, 4, 1]


def test_collisions_are_verified(monkeypatch):
    monkeypatch.setattr(S.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    rng = random.Random(2)
    marks = S.repeated_starts([random_bytes(rng, 100), random_bytes(rng, 100)], np.zeros(2, int), 60)
    assert not any(m.any() for m in marks)


def test_a_suffix_is_compared_once_with_its_copy(monkeypatch):
    rng = random.Random(7)
    base = random_bytes(rng, 500)
    compared, common = [], S.PrefixHashes.common
    monkeypatch.setattr(S.PrefixHashes, "common", lambda self, x, y, limit: compared.append(len(x)) or common(self, x, y, limit))
    marks = S.repeated_starts([random_bytes(rng, 30) + b"x" + base, random_bytes(rng, 40) + b"y" + base], np.zeros(2, int), 60)
    assert [int(m.sum()) for m in marks] == [441, 441]
    assert sum(compared) <= sum(len(m) for m in marks)


def test_many_different_contexts_in_order():
    rng = random.Random(8)
    base = random_bytes(rng, 90)
    for unit, joined in ((1, b""), (2, b" ")):
        contexts = []
        for _ in range(120):  # they part from one another at many places
            a = rng.randint(8, 80)
            contexts.append(joined.join(bytes([x]) * unit for x in base[:a] + random_bytes(rng, 90 - a).replace(b" ", b"c") if x != 32)[:160])
        data = S.units([joined.join(contexts)], S.Law(20, 0, unit == 2))[0]
        starts = np.arange(len(data) - 19)
        group = np.sort(np.array([rng.randint(0, 2) for _ in starts]))
        order, same = S._suffix_order(S.PrefixHashes(data), data, starts, group, 20)
        keys = [(g, data[s:s + 20].tolist()) for g, s in zip(group[order].tolist(), starts[order].tolist(), strict=True)]
        assert keys == sorted(keys)
        assert same.tolist() == [False] + [x == y for x, y in zip(keys, keys[1:])]


def test_stretches_are_verified():
    rng = random.Random(9)
    base = random_bytes(rng, 300)
    text = base + base[:100] + b"#" + base[101:] + random_bytes(rng, 50)
    x = np.array([rng.randint(0, 290) for _ in range(400)])
    y = np.where(np.arange(400) % 3 == 0, x + 1, x + 300)
    begin = np.arange(len(text))
    got = S._equal_pairs(text, begin, begin[9:] + 1, x, y)
    assert got.tolist() == [text[a:a + 10] == text[b:b + 10] for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    assert 0 < got.sum() < 266


def test_words_as_numbers():
    texts = [b"", b" a  a\0 \x00a ab\tabcdefgh\x0babcdefghi", b"abcdefgh", b"\n", "é\u00a0é a".encode(), b"abcdefghi abcdefgh\0 a"]
    found = S.units(texts, S.PASSAGES)
    assert [len(f) for f in found] == [len(t.split()) for t in texts]
    pairs = {(w, n) for t, f in zip(texts, found, strict=True) for w, n in zip(t.split(), f.tolist(), strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({n for _, n in pairs})
    for t in texts:
        begin, end = S._edges(t)
        assert [t[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)] == t.split()


def made(seed):
    rng = random.Random(seed)
    passage, other = random_bytes(rng, 900), random_bytes(rng, 430)
    docs = [random_bytes(rng, rng.randint(0, 1500)) for _ in range(10)]
    for i in range(14):
        a, b = sorted((rng.randint(0, 300), rng.randint(500, 900)))
        docs.append(random_bytes(rng, rng.randint(0, 400)) + passage[a:b] + random_bytes(rng, rng.randint(0, 400)))
        docs.append(random_bytes(rng, rng.randint(0, 90)) + other + random_bytes(rng, 50) + (other if i % 3 == 0 else b""))
    docs += [docs[0], docs[12], docs[12], passage[:399], passage[:399], passage[:400], b"z" * 900, b"ab" * 450, b"short", b"short"]
    docs.append("é".encode() * 300 + passage[:450] + "é".encode() * 10)
    return docs


@pytest.mark.parametrize("together, laws", [(S.TOGETHER, S.BOTH), (3, (S.BYTES,))])
def test_digests_against_brute_force(spark, documents, monkeypatch, together, laws):
    monkeypatch.setattr(S, "TOGETHER", together)
    texts = made(together)
    rows = S.digests(documents(*[(i, t.decode()) for i, t in enumerate(texts)]), laws).collect()
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert got == brute(texts)


def test_small_batches(spark, documents, monkeypatch):
    texts = made(9)
    monkeypatch.setattr(S, "AT_ONCE", 2_000)
    monkeypatch.setattr(S, "SUFFIXES_AT_ONCE", 500)
    assert len(S.anchors(texts)) == len(texts)
    rows = S.digests(documents(*[(i, t.decode()) for i, t in enumerate(texts)])).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sorted(rows, key=lambda r: r.doc_id)] == brute(texts)


def test_a_text_in_parts():
    text = random_bytes(random.Random(3), 6_000_000)
    hashes, last, keys = S._huge(text)
    assert last[-1] == len(text) - S.LENGTH and (np.diff(last) > 0).all() and len(hashes) == len(keys) == len(last)


def test_kept_text(spark, documents):
    texts = made(5)
    docs = documents(*[(i, t.decode()) for i, t in enumerate(texts)]).selectExpr("*", "doc_id as key", "doc_id as kept_text", "1 as spans")
    cut = S.without_repeats(docs, (S.BYTES,))
    out = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == docs.columns and len(out) == len(texts)
    for i, (t, (n, gone, _, digest)) in enumerate(zip(texts, brute(texts), strict=True)):
        kept = out[i].text.encode()
        assert out[i].n_chars == len(out[i].text) and out[i].key == i
        assert len(kept) <= n - gone and (not gone or t != kept)
        if t.isascii():
            assert hashlib.sha256(kept).hexdigest() == digest


def test_odd_rows(spark, odd, documents):
    rows = S.digests(odd).collect()
    texts = [((r.doc_id, r.text or "")) for r in odd.collect()]
    expected = Counter((d, *x) for (d, _), x in zip(texts, brute([t.encode() for _, t in texts]), strict=True) if d != 5)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows if r.doc_id != 5) == expected
    [long] = [r for r in rows if r.doc_id == 5]
    assert long.n_removed == long.n_bytes and long.n_spans == 1
    assert S.digests(documents()).count() == 0
    assert S.without_repeats(odd).count() == odd.count() and S.without_repeats(documents()).count() == 0


def test_blocks_of_a_large_anchor():
    """Equal strings of an anchor's contexts meet in blocks; most strings that no other context has do not."""
    rng = random.Random(10)
    law = S.Law(60, 20)
    texts = [random_bytes(rng, 100) + b"the passage that all of these texts hold, and it is longer than sixty bytes, as it must be" + random_bytes(rng, 100)
             for _ in range(30)]
    many, blocks, starts, met = Counter(t[i:i + 60] for t in texts for i in range(len(t) - 59)), Counter(), 0, {}
    for n, text in enumerate(texts):
        hashes, last, _ = S.anchors([text], law)[0]
        first = 0
        for h, end in zip(hashes.tolist(), last.tolist(), strict=True):
            low, high, shared = S._blocks(np.frombuffer(text[first:end + 60], np.uint8), law, 8)
            assert low[0] == 0 and high[-1] == end - first and (low[1:] == high[:-1] + 1).all() and (high - low < 8).all()
            for a, b, x in zip(low.tolist(), high.tolist(), shared.tolist(), strict=True):
                blocks[h, x] += 1
                starts += b - a + 1
                for i in range(first + a, first + b + 1):
                    met.setdefault(text[i:i + 60], set()).add((h, x))
            first = end + 1
    assert all(len(met[t]) == 1 for t, n in many.items() if n > 1) and any(n > 1 for n in many.values())
    assert starts == sum(len(t) - 59 for t in texts) and sum(blocks.values()) < starts / 3
    assert sum(n for n in blocks.values() if n > 1) < 30 * 12


def brute_words(texts, length):
    """Per text the places of its words, and the words that a repeated run of ``length`` words covers."""
    cut = [t.split() for t in texts]
    many = Counter(tuple(w[i:i + length]) for w in cut for i in range(len(w) - length + 1))
    return [{j for i in range(len(w) - length + 1) if many[tuple(w[i:i + length])] > 1 for j in range(i, i + length)} for w in cut]


def worded(seed):
    rng = random.Random(seed)
    word = lambda n: [rng.choice(("a", "of", "the", "word", "é", "river", "b.", "x1")) + str(rng.randint(0, 99)) for _ in range(n)]
    passages = {n: word(n) for n in (50, 51, 58, 120)}
    docs = [word(rng.randint(0, 200)) + passages[n] + word(rng.randint(0, 200)) for n in passages for _ in range(4)]
    docs += [word(9) + passages[120][a:b] + word(5) + passages[58][:c] for a, b, c in ((0, 51, 51), (30, 100, 50), (69, 120, 58), (5, 52, 7))]
    docs += [docs[0], docs[0], passages[51], passages[50], word(3), [], ["z"] * 200]
    return [("\n" if i % 2 else "  ").join(d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("together", [S.TOGETHER, 3])
def test_runs_of_words_against_brute_force(spark, documents, monkeypatch, together):
    monkeypatch.setattr(S, "TOGETHER", together)
    texts = worded(together)
    assert any(0 < len(" ".join(t.split()[i] for i in sorted(g))) < 400 for t, g in zip(texts, brute_words(texts, 51), strict=True))
    rows = S.without_repeats(documents(*enumerate(texts)), (S.PASSAGES,)).collect()
    got = {r.doc_id: r.text.split() for r in rows}
    assert len(rows) == len(texts)
    for i, (t, gone) in enumerate(zip(texts, brute_words(texts, 51), strict=True)):
        assert got[i] == [w for j, w in enumerate(t.split()) if j not in gone]


def test_hashes_of_words_are_verified(monkeypatch):
    monkeypatch.setattr(S.PrefixHashes, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    rng = random.Random(4)
    texts = [b" ".join(b"%d" % rng.randint(0, 9) for _ in range(70)) for _ in range(2)]
    assert not any(m.any() for m in S.repeated_starts(texts, np.zeros(2, int), 51, words=True))


def test_the_pipeline_catches_short_passages(spark, documents):
    """Runs of 51 words below 400 bytes, strings of 400 bytes with few words, and one that overlaps the other."""
    from leadlake.llm import stages
    from leadlake.session import store

    rng = random.Random(6)
    own = lambda k: [f"own{k}x{rng.randint(0, 10**6)}" for _ in range(40)]
    run = [f"w{i}" for i in range(51)]
    long = [f"{i:02}" * 12 for i in range(17)]  # 17 words, over 400 bytes
    assert len(" ".join(run)) < S.LENGTH < len(" ".join(long))
    texts = [own(0) + run + own(1), own(2) + run + own(3), own(4) + long + own(5), own(6) + long[:-1] + run + own(7),
             own(8) + run[-20:] + long + own(9), own(10) + run[-20:] + long + own(11), own(12) + run[:50] + own(13)]
    own_words = [[w for w in t if w[:3] == "own"] for t in texts]
    docs = documents(*[(i, " ".join(t)) for i, t in enumerate(texts)])
    near = store(stages.near_dedup(spark, docs, ""))
    assert {r.doc_id: r.text for r in near.collect()} == {i: " ".join(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in stages.suffix_dedup(spark, near, "").collect()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    whole = [" ".join(t).encode() for t in texts]
    for i, (t, covered) in enumerate(zip(whole, brute_words(whole, 51), strict=True)):
        gone = np.zeros(len(t), bool)
        places = [m.span() for m in re.finditer(rb"\S+", t)]
        for j in covered:
            gone[places[j][0]:places[j + 1][0] if j + 1 in covered else places[j][1]] = True
        for j in range(len(t) - S.LENGTH + 1):
            if sum(o.count(t[j:j + S.LENGTH]) for o in whole) > 1:
                gone[j:j + S.LENGTH] = True
        assert got[i].text.encode() == bytes(b for b, g in zip(t, gone, strict=True) if not g)
    assert {r.doc_id: r.text for r in S.digests(docs).collect()} == {i: r.text for i, r in got.items()}
    assert got[0].text.split() == own_words[0] and got[6].text.encode() == whole[6]

import random
from collections import Counter

import numpy as np

from leadlake.llm import graph
from leadlake.llm import minhash as M


def similarity(a, b):
    def bag(text):
        words = [w for w in M._WORD.findall(text)]
        return Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()

    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def classes(docs):
    ids = sorted({d for d, _ in docs})
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if (s or "") and (t or "") and similarity(s, t) >= M.LEAST:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_agreement_is_the_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    weight = rng.integers(1, 6, 300)
    other = np.where(rng.random(300) < 0.3, rng.integers(1, 9, 300), weight)
    true = np.minimum(weight, other).sum() / np.maximum(weight, other).sum()
    shares = []
    for r in range(40):
        e = M.mix(a + np.uint64(r))
        s = M.signatures([(e, weight), (e, other), (e[:0], weight[:0])])
        assert (s[:2] != 0).all() and (s[2] == 0).all()
        shares.append((s[0] == s[1]).mean())
    assert abs(np.mean(shares) - true) < 0.03


def test_shingles_of_short_and_odd_texts():
    assert len(M.shingles("")[0]) == 0 and len(M.shingles(" \n")[0]) == 0
    assert M.shingles("a b")[1].tolist() == [1]
    assert M.shingles("x " * 9)[1].tolist() == [5]
    assert len(M.shingles("a\xa0b c d e f")[0]) == 1  # five words: the no-break space is no separator


def corpus(seed, copies):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = []
    for _ in range(25):
        docs.append(" ".join(word() for _ in range(rng.randint(3, 120))))
    base = [word() for _ in range(150)]
    for _ in range(copies):  # near copies that are not all near each other
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = word()
        docs.append(" ".join(text))
    docs += [docs[3], docs[3], docs[30]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_classes_against_brute_force(spark, documents):
    docs = corpus(1, 60)
    rows = M.near_classes(documents(*docs)).collect()
    expected = classes(docs)
    assert {r.doc_id: r.class_id for r in rows} == expected and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_families_find_what_stars_miss(spark, documents, monkeypatch):
    # The leader of a bucket is unlike the others, which are near each other; small blocks.
    monkeypatch.setattr(M, "BLOCK", 7)
    docs = corpus(2, 40)
    rng = random.Random(8)
    base = docs[-1][1].split()
    for i in range(12):
        text = base[:]
        for _ in range(6):
            text[rng.randrange(len(text))] = f"edit{rng.randrange(3)}"
        docs.append((100 + i, " ".join(text)))
    assert {r.doc_id: r.class_id for r in M.near_classes(documents(*docs)).collect()} == classes(docs)


def test_odd_rows(spark, odd, documents):
    rows = M.near_classes(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(r.kept for r in rows)
    assert {r.class_id for r in rows if r.doc_id == 3} == {3}
    assert M.near_classes(documents()).count() == 0


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 5), (2, 1), (1, 2)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def test_family_links_join_each_class_once():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(50):
        t = words[:]
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(120)] = f"x{rng.randrange(6)}"
        texts.append(" ".join(t + ["again"] * rng.randint(0, 9)))
    sets = [M.shingles(t) for t in texts]
    ids = np.arange(50)
    every = np.ones(50, bool)
    links = M.family_links(ids, ids, sets, every, every)
    expected = classes(list(enumerate(texts)))
    assert len(links) == 50 - len(set(expected.values()))
    assert all(similarity(texts[a], texts[b]) >= M.LEAST for a, b in links)
    halves = ids % 2 == 0
    crossing = M.family_links(ids, ids, sets, halves, ~halves)
    assert all(halves[a] and not halves[b] for a, b in crossing)


def test_unlike_texts_under_one_id(spark, documents):
    """They are told apart; of those in one class one is kept."""
    from leadlake.llm import stages

    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "x")
    other = " ".join(f"y{i}" for i in range(60))
    docs = documents((1, long), (1, other), (2, other), (3, near), (1, near), (1, long), (4, "z"))
    rows = M.text_classes(docs).collect()
    assert len(rows) == 7 and {r.class_id for r in rows} == {1, 4}
    of = {(r.doc_id, r.key): r.kept for r in rows}
    assert sum(of.values()) == 3  # one of long and near, one of other, z
    kept = stages.near_dedup(spark, docs, "").collect()
    assert len(kept) == 3 and {r.text for r in kept} in ({long, other, "z"}, {near, other, "z"})
    assert {r.doc_id for r in kept} == {1, 4}

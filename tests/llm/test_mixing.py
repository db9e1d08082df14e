import hashlib
import random
from collections import defaultdict

from leadlake.llm import mixing as M

LEVELS = ["lang", "source"]
WEIGHTS = {"lang": {"en": 3, "de": 1}, "source": {"src1": 2}}


def fill(budget, children):
    """children: {name: (weight, capacity)}. Siblings share what a full one leaves."""
    got, open_ = {}, dict(children)
    while open_:
        level = budget / sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c <= w * level}
        if not full:
            return got | {n: w * level for n, (w, _) in open_.items()}
        got |= full
        budget -= sum(full.values())
        open_ = {n: x for n, x in open_.items() if n not in full}
    return got


def brute(docs, share, epochs, seed):
    leaves = defaultdict(list)
    for d, n, lang, source in docs:
        leaves[lang, source].append((d, n))
    size = {k: sum(n for _, n in v) for k, v in leaves.items()}
    langs = {k[0] for k in leaves}
    top = fill(int(sum(size.values()) * share), {x: (WEIGHTS["lang"].get(x, 1), sum(s for k, s in size.items() if k[0] == x) * epochs) for x in langs})
    out = []
    for x in langs:
        own = fill(top[x], {k[1]: (WEIGHTS["source"].get(k[1], 1), s * epochs) for k, s in size.items() if k[0] == x})
        for source, given in own.items():
            budget = int(given + 1e-6)
            whole = budget // size[x, source] if size[x, source] else 0
            rest, before = budget - whole * size[x, source], 0
            order = sorted(leaves[x, source], key=lambda r: (
                hashlib.md5(f"{seed}:{whole}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1]))
            for d, n in order:
                out.append((d, n, x, source, budget, whole + (before < rest)))
                before += n
    return sorted(out, key=str)


def check(spark, documents, docs, share, epochs):
    table = documents(*[(d, " ".join("w" * n), lang, source, n) for d, n, lang, source in docs])
    rows = M.mix(table, LEVELS, WEIGHTS, share, epochs, 7).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.lang, r.source, r.leaf_budget, r.copies) for r in rows], key=str) == brute(docs, share, epochs, 7)


def test_against_brute_force(spark, documents):
    rng = random.Random(5)
    docs = [(i, rng.randint(0, 60), rng.choice(["en", "en", "en", "de", "fr"]), rng.choice(["src0", "src0", "src1", "src2"])) for i in range(400)]
    for share, epochs in ((0.4, 1), (1.0, 4), (3.0, 2)):
        check(spark, documents, docs, share, epochs)


def test_shortage_goes_to_siblings_first(spark, documents):
    docs = [(i, 10, "en", "src1") for i in range(2)] + [(10 + i, 10, "en", "src2") for i in range(60)] + [(100 + i, 10, "de", "src3") for i in range(60)]
    table = documents(*[(d, " ".join("w" * n), lang, source, n) for d, n, lang, source in docs])
    budget = {r.source: r.leaf_budget for r in M.mix(table, LEVELS, {}, 0.5, 1, 7).collect()}
    assert budget == {"src1": 20, "src2": 285, "src3": 305}


def test_odd_rows(spark, odd, documents):
    rows = M.mix(odd, ["lang", "source"], {}, 0.5, 2).collect()
    assert len(rows) == odd.count()
    assert {r.lang for r in rows} == {"en", "unknown"}
    assert M.mix(documents(), ["lang", "source"], {}).count() == 0
    assert M.mix(M.with_domain(odd), M.LEVELS, M.WEIGHTS).count() == odd.count()

import hashlib
import random
import re
import time

import pytest

from leadlake.llm import personal as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(sum(map(int, str(d))) for d in doubled) % 10 == 0


def brute(text):
    """The base spans by plain searches."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and slow_luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def base(text):
    return [f"{s.kind}:{s.start}:{s.end}" for s in P.find(text) if s.kind in P.BASE]


def with_check_digit(rng, n):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + d for d in "0123456789" if slow_luhn(digits + d))


def noise(rng):
    pieces = ["@", "a.b", "+1", "x", " ", "-", "..", ".", "(", ")", "12", "1.2.3.4", "256.1.1.1", "é", "\n", "b@c", "b@c.de", "+49 (030) 123 4567", "%"]
    text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
    number = with_check_digit(rng, rng.randint(12, 21))
    return text + rng.choice(["", " "]) + "-".join(re.findall(".{1,4}", number)) + rng.choice([" ", "a", "@x.y", ""]) + text[::-1]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_against_plain_searches(seed):
    rng = random.Random(seed)
    found = set()
    for _ in range(1500):
        text = noise(rng)
        assert base(text) == brute(text), text
        found |= {s.split(":")[0] for s in brute(text)}
    assert found == set(P.BASE)


def test_query_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = P.digests(docs).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 50
    for r in rows:
        expected = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in expected) for k in P.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest()
        assert r.spans == P.joined(P.find(texts[r.doc_id]))
        assert set(expected) <= set(r.spans.split(","))


def test_checksums():
    assert P.luhn("4111111111111111") and not P.luhn("4111111111111112")
    assert P.mod97("DE89370400440532013000") and P.mod97("GB82WEST12345698765432") and not P.mod97("DE88370400440532013000")


def kinds(text):
    return [(s.kind, text[s.start:s.end]) for s in P.find(text)]


def test_added_spans_need_a_checksum_or_a_word():
    assert kinds("pay to DE89 3704 0044 0532 0130 00 today") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 today") == []
    assert kinds("her SSN is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("code 123-45-6789 again") == [] and kinds("SSN 666-45-6789") == [] and kinds("SSN 123-45-0000") == []
    assert kinds("call (743) 555-3824 now") == [("tel", "(743) 555-3824")]
    assert kinds("sum (743) 555-3824 now") == [] and kinds("call about order (743) 555-3824") == []
    assert kinds("call +1 (743) 555-3824 now") == [("phone", "+1 (743) 555-3824")]


def test_words_nearby_move_the_score():
    [plain], [card], [order] = (P.find(t + " 4111 1111 1111 1111") for t in ("see", "visa card", "order"))
    assert order.score < plain.score < card.score


def test_redacted():
    text = "write to ab@cd.ef or call +1 (743) 555-3824"
    assert P.redacted(text, P.find(text)) == "write to [EMAIL] or call [PHONE]"
    assert P.redacted("abcdef", [P.Span("iban", 1, 4, 1.0), P.Span("card", 2, 5, 1.0)]) == "a[IBAN]f"


@pytest.mark.parametrize("piece", ["a", "1", "1.", "1 ", "a@", "@", "+1", "+1(", "a.", "12-", "0 ", "A", "AB12 ", "(12)", "1.1.1.1 ", "a@b.c "])
def test_time_is_linear(piece):
    text = piece * (1_000_000 // len(piece))
    started = time.perf_counter()
    P.find(text)
    assert time.perf_counter() - started < 20


def test_odd_rows(spark, odd, documents):
    rows = P.digests(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == "" and r.base_sha256 == P.EMPTY_SHA256 and r.n_email == 0 for r in rows)
    assert sorted((r.doc_id or 0) for r in rows) == sorted((r.doc_id or 0) for r in odd.collect())
    assert P.digests(documents()).count() == 0
    twice = documents((1, "ab@cd.ef"), (1, "ab@cd.ef"), (None, "é ab@cd.ef"))
    assert sorted(r.spans for r in P.digests(twice).collect()) == ["email:0:8", "email:0:8", "email:2:10"]

"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

A pattern proposes a span of a kind, with the score that its form alone deserves. A validator
then looks at the characters: Luhn for card numbers, mod-97 for IBANs, the parts of an address,
the rules of a social security number. A span that fails it is dropped, one that passes gains.
Last, the words within ``NEAR`` characters count: words that announce the kind raise the score,
words that announce another number (a version, an order) lower it. Kinds whose form is clear
(``BASE``) are always reported; the others need a score of ``least``: an IBAN has it from its
checksum, a national phone number or a social security number needs a word that announces it.

Every pattern starts where a run of its characters starts, or walks back from its ``@``, so a
text costs time in proportion to its length, whatever it holds. A document is one row and one
small computation where it lies; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")
NEAR = 48
LEAST = 0.6

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])")
_TEL = re.compile(r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{2,5}\)[ -]?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9A-Za-z-])")

#: Words, in the languages of the corpora, that announce a kind and that announce another number.
_ANNOUNCE = {
    "email": "email mail e-mail contact contacto kontakt correo courriel write reply",
    "ip": "ip address adresse dirección host server client login",
    "card": "card visa mastercard amex credit debit karte kreditkarte carte tarjeta payment zahlung paiement pago",
    "phone": "phone tel telephone mobile cell call fax telefon handy anruf téléphone appel teléfono móvil llamar",
    "iban": "iban account bank konto bic swift compte banque cuenta banco transfer",
    "ssn": "ssn social security sozialversicherung sécurité seguridad taxpayer tin",
    "tel": "phone tel telephone mobile cell call fax telefon handy anruf téléphone appel teléfono móvil llamar",
}
_ELSE = "version release order invoice isbn issn serial sku part ticket build figure page chapter bestellung rechnung commande facture pedido factura"
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


@dataclass(frozen=True)
class Span:
    """Code points ``start`` up to ``end`` of a text."""

    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The same spans as a leftmost search for local@domain, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _matches(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def _address(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _social(found: str) -> bool:
    area, group, serial = found[:3], found[4:6], found[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _card(found: str) -> bool:
    digits = _digits(found) if len(found) <= 40 else ""
    return 14 <= len(digits) <= 19 and luhn(digits)


#: Per kind: how spans are proposed, what confirms one, the score of the form and what a passed validator adds.
_RULES: dict[str, tuple[Callable[[str], Iterator[tuple[int, int]]], Callable[[str], bool] | None, float, float]] = {
    "email": (_emails, None, 0.9, 0.0),
    "ip": (_matches(_IP), _address, 0.3, 0.3),
    "card": (_matches(_CARD), _card, 0.3, 0.5),
    "phone": (_matches(_PHONE), lambda s: 10 <= sum(c in "0123456789" for c in s) <= 15, 0.5, 0.2),
    "iban": (_matches(_IBAN), lambda s: len(s.replace(" ", "")) <= 34 and mod97(s.replace(" ", "")), 0.3, 0.5),
    "ssn": (_matches(_SSN), _social, 0.2, 0.2),
    "tel": (_matches(_TEL), lambda s: 7 <= len(_digits(s)) <= 12, 0.3, 0.1),
}
#: What a match needs, so that most texts meet few patterns.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_HAS_DIGIT = re.compile("[0-9]")
_ANNOUNCED = {k: frozenset(v.split()) for k, v in _ANNOUNCE.items()}
_OTHER = frozenset(_ELSE.split())


def context(text: str, kind: str, start: int, end: int) -> float:
    """What the words near a span add to its score: 0.3 if one announces the kind, -0.3 if one announces another number."""
    words = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR):start])}
    words |= {w.lower() for w in _WORD.findall(text[end:end + NEAR // 2])}
    return 0.3 * bool(words & _ANNOUNCED[kind]) - 0.3 * bool(words & _OTHER)


def find(text: str, least: float = LEAST) -> list[Span]:
    """The spans of a text by start, then kind in the order of ``KINDS``.

    Base kinds come whatever their score. An added span needs ``least``; one without a checksum
    gives way to any other span that it overlaps.
    """
    out: list[Span] = []
    has_digit = bool(_HAS_DIGIT.search(text))
    for kind, (propose, valid, form, passed) in _RULES.items():
        if (kind != "email" and not has_digit) or _NEEDS.get(kind, "") not in text:
            continue
        for start, end in propose(text):
            if valid is not None and not valid(text[start:end]):
                continue
            score = min(1.0, max(0.0, form + passed + context(text, kind, start, end)))
            if kind in BASE or score >= least:
                out.append(Span(kind, start, end, round(score, 2)))
    sure = sorted((s.start, s.end) for s in out if s.kind not in ("ssn", "tel"))
    for kind in ("ssn", "tel"):
        kept = [s for s in out if s.kind == kind and not _overlaps(sure, s)]
        out = [s for s in out if s.kind != kind] + kept
        sure = sorted(sure + [(s.start, s.end) for s in kept])
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def _overlaps(spans: list[tuple[int, int]], s: Span) -> bool:
    """Whether one of the spans, sorted, overlaps s; at most an IBAN and its digits overlap each other."""
    at = bisect_left(spans, (s.end, 0))
    return any(b > s.start for _, b in spans[max(0, at - 3):at])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    out, done = [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done:s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def personal_data(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, found (the spans, with scores), redacted (the text without them).

    A null text counts as empty and has no span; repeated rows get a row each, null ids stay
    null, extra columns are left out, an empty table stays empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [find(t, least) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([[vars(s) for s in f] for f in found], kind),
                pa.array([redacted(t, f) for t, f in zip(texts, found, strict=True)], pa.string()),
            ], names=["doc_id", "found", "redacted"])

    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return chosen.mapInArrow(run, f"doc_id bigint, found {SPANS}, redacted string")


def digests(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = F.col("found")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter(found, lambda s: s["kind"].isin(*kinds))

    base, counts = of(*BASE), [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE]
    return personal_data(docs, least).select("doc_id", *counts, F.sha2(text_of(base), 256).alias("base_sha256"), text_of(found).alias("spans"))


EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

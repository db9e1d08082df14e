import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadlake.llm.packing import pack, pack_documents, pack_histogram, sequences
from leadlake.llm.tokens import byte_encoder, word_encoder

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def one_at_a_time(lengths, capacity):
    """Longest first, each into the open pack with the most room; the number of packs."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(rooms)), key=rooms.__getitem__, default=None)
        if best is not None and rooms[best] >= n:
            rooms[best] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_histogram_packs_like_single_placement(lengths):
    counts = Counter(lengths)
    runs = pack_histogram(counts, 40)
    slots = [(r["sequence_base"] + i, r["offset"], r["length"]) for r in runs for i in range(r["until"] - r["first"])]
    assert Counter(n for *_, n in slots) == counts
    for n in counts:  # every rank of a length once
        assert sorted(k for r in runs if r["length"] == n for k in range(r["first"], r["until"])) == list(range(counts[n]))
    packs = {}
    for s, offset, n in sorted(slots):
        assert offset == packs.get(s, 0)
        packs[s] = offset + n
    assert all(v <= 40 for v in packs.values())
    assert sorted(packs) == list(range(len(packs))) and len(packs) == one_at_a_time(lengths, 40)


ALPHABET = [" ", "  ", "\n", "\n\n", "\t", "'s", "a", "Bc", "é", "́", "Σ", "1", "23", "!", "?!", "\x1c", "\x85", "\xa0", "　", "😀",
            "<|endoftext|>", "\r\n", "\0", "the", " the"]


@pytest.mark.parametrize("path,encoder", [(WORDS, word_encoder), (BYTES, byte_encoder)])
def test_encoder_equals_tokenizer(path, encoder):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(ALPHABET, rng.integers(0, 25))) for _ in range(3000)]
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    expected = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder(path)(texts)] == expected


def test_a_full_encoder_forgets(monkeypatch):
    from leadlake.llm import tokens

    monkeypatch.setattr(tokens, "MOST_CHUNKS", 5)
    encoder = tokens._Encoder(WORDS, str.split, str, " \0 ")
    model = Tokenizer.from_file(WORDS)
    for i in range(6):
        texts = [f"word{i} other{j} same" for j in range(4)]
        assert [x.tolist() for x in encoder(texts)] == [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    assert len(encoder.chunks) <= 20


def held(packed, docs):
    model = Tokenizer.from_file(WORDS)
    rows = packed.collect()
    expected = Counter()
    for doc_id, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 64):
            piece = np.array(ids[start:start + 64], "<u4")
            expected[doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == expected
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(v <= 64 for v in ends.values()) and sorted(ends) == list(range(len(ends)))
    return rows


def test_pieces_and_sequences(spark, odd):
    packed = pack_documents(odd, WORDS, 64, with_ids=True)
    rows = held(packed, [(r.doc_id, r.text) for r in odd.collect()])
    for s in sequences(packed).collect():
        whole = [i for r in sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset) for i in r.ids]
        assert s.ids == whole


def test_hot_length_and_empty(spark, documents):
    docs = [(i, "same text again") for i in range(300)] + [(1000 + i, "w " * i) for i in range(60)]
    held(pack_documents(documents(*docs), WORDS, 64), docs)
    assert pack_documents(documents(), WORDS, 64).count() == 0


def test_equal_pieces_get_places_of_their_own(spark):
    rows = spark.createDataFrame([(1, 3)] * 50, "id long, length long")
    placed = pack(rows, 7, ["id"]).collect()
    assert len({(r.sequence_id, r.offset) for r in placed}) == 50

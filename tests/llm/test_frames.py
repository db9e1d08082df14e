import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from leadlake.llm import frames as R
from leadlake.session import new_folder

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def written(documents, wide=False):
    stream = io.BytesIO()
    writer = R.FrameWriter(stream, wide)
    for i, ids in documents:
        writer.add(i, np.array(ids, np.int32))
    writer.close()
    return stream.getvalue()


def reader(data, wide=False):
    return R.FrameReader(pa.PythonFile(io.BytesIO(data), "r"), wide)


@pytest.mark.parametrize("wide", [False, True])
def test_round_trip_and_plain_readers(wide):
    documents = [(3, [1, 2, 3]), (9, []), (12, list(range(3000)))]
    data = written(documents, wide)
    file = reader(data, wide)
    assert [file.document(i).tolist() for i, _ in documents] == [ids for _, ids in documents]
    with pytest.raises(KeyError):
        file.document(4)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u4" if wide else "<u2").tolist() == [x for _, ids in documents for x in ids]


def test_only_the_wanted_frame_is_read():
    data = bytearray(written([(1, list(range(100))), (2, list(range(100, 300)))]))
    file = reader(bytes(data))
    data[int(file.starts[0]) + 12] ^= 0xFF  # damage the other document
    assert reader(bytes(data)).document(2).tolist() == list(range(100, 300))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader(bytes(data)).document(1)


def test_checksum_catches_a_wrong_frame():
    data = written([(1, [7, 8, 9])])
    file = reader(data)
    file.checks = file.checks ^ 1
    with pytest.raises(ValueError):
        file.document(1)


def check(rows, docs):
    model = Tokenizer.from_file(BYTES)
    first = lambda d: (d is not None, d or 0)  # noqa: E731  documents without an id come first
    sized = sorted((*first(d), len(ids := [*model.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes()))
                   for d, t in docs)
    assert sorted((*first(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sized
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    in_order = [first(r.doc_id) for r in sorted(rows, key=lambda r: r.start)]
    assert in_order == sorted(in_order)


def test_files_of_a_table(spark, documents, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(R.token_files(docs, BYTES).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark, odd, documents):
    check(R.token_files(odd, BYTES).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert R.token_files(documents(), BYTES).count() == 0


def test_documents_without_an_id(spark, documents, monkeypatch):
    monkeypatch.setattr(R, "FRAMES_AT_ONCE", 3)
    docs = [(None, f"text {i}") for i in range(8)] + [(0, "zero"), (-5, "minus"), (7, None)]
    rows = R.token_files(documents(*docs).repartition(4), BYTES).collect()
    check(rows, docs)
    assert sum(r.doc_id is None for r in rows) == 8
    file = reader(written([(None, [1, 2]), (None, [3]), (-4, [4]), (0, [5, 6])]))
    assert (file.nulls, file.document(-4).tolist(), file.document(0).tolist()) == (2, [4], [5, 6])
    with pytest.raises(KeyError):
        file.document(1)


def test_slices_of_a_file(spark, documents, monkeypatch):
    monkeypatch.setattr(R, "FRAMES_AT_ONCE", 7)
    docs = [(i, f"text {i}") for i in range(100)]
    manifest = R.write_tokens(documents(*docs), BYTES, new_folder(spark, "token-files"))
    for r in manifest.collect():
        files, place = pyarrow.fs.FileSystem.from_uri(r.path if "://" in r.path else f"file://{r.path}")
        with files.open_input_file(place) as file:
            assert len(R.FrameReader(file, r.wide).ids) == r.n_docs
    check(R.read_tokens(spark, manifest).collect(), docs)

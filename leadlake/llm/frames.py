"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds the documents of one range of ids, in ascending order, a frame per document:
its token ids as little-endian unsigned 16-bit numbers, or 32-bit where the vocabulary needs
it. Two skippable frames follow, which any zstandard reader passes over: the document ids
(zstandard-compressed signed 64-bit numbers: how many documents have no id, which come first and
count as 0, then the ids), and the seek table of the public seekable
format: compressed size, decompressed size and checksum (the low 32 bits of XXH64) of each
frame, then the number of frames, a descriptor and a magic number. A reader finds the table
from the file's end and decompresses only the documents it wants.

Files are written by the tasks that sorted their range, wherever the shared folder is, under
a name of their own for each attempt; a manifest table, stored once, names the files of the
attempts that succeeded. A repeated or lost task therefore never mixes with another. An
attempt that dies leaves an unnamed file behind for the folder's expiry.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake.llm.common import partitions
from leadlake.llm.tokens import byte_encoder
from leadlake.session import new_folder, store

#: Fixed values of the format.
SKIPPABLE_IDS, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
WITH_CHECKSUMS = 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")

FRAMES_AT_ONCE = 5_000  # frames that one reading task takes from a file


class FrameWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, stream, wide: bool, level: int = 3) -> None:
        self.stream, self.kind = stream, "<u4" if wide else "<u2"
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.table, self.ids, self.nulls = bytearray(), [], 0

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        """Documents without an id come before all others."""
        raw = tokens.astype(self.kind).tobytes()
        frame = self.compressor.compress(raw)
        self.stream.write(frame)
        self.table += ENTRY.pack(len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.nulls += doc_id is None
        self.ids.append(doc_id or 0)

    def close(self) -> None:
        packed = self.compressor.compress(np.array([self.nulls, *self.ids], "<i8").tobytes())
        self.stream.write(struct.pack("<II", SKIPPABLE_IDS, len(packed)) + packed)
        body = bytes(self.table) + FOOTER.pack(len(self.ids), WITH_CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)


class FrameReader:
    """Reads chosen documents of an open random-access file."""

    def __init__(self, file, wide: bool) -> None:
        self.file, self.kind = file, "<u4" if wide else "<u2"
        size = file.size()
        frames, flags, magic = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != SEEKABLE or not flags & WITH_CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        body = ENTRY.size * frames + FOOTER.size
        table = np.frombuffer(file.read_at(ENTRY.size * frames, size - body), "<u4").reshape(frames, 3)
        self.sizes, self.raw_sizes, self.checks = (table[:, i].astype(np.int64) for i in range(3))
        self.starts = np.cumsum(self.sizes) - self.sizes
        at = int(self.sizes.sum())
        magic, length = struct.unpack("<II", file.read_at(8, at))
        if magic != SKIPPABLE_IDS:
            raise ValueError("the frames do not end where the seek table says")
        self.decompressor = zstandard.ZstdDecompressor()
        counted = np.frombuffer(self.decompressor.decompress(file.read_at(length, at + 8)), "<i8")
        self.nulls, self.ids = int(counted[0]), counted[1:]

    def tokens(self, frame: int) -> np.ndarray:
        """The token ids of one frame; its checksum must hold."""
        raw = self.decompressor.decompress(self.file.read_at(int(self.sizes[frame]), int(self.starts[frame])))
        if len(raw) != self.raw_sizes[frame] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[frame]:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(raw, self.kind)

    def document(self, doc_id: int) -> np.ndarray:
        """The first document with this id; nothing else is decompressed."""
        frame = self.nulls + int(np.searchsorted(self.ids[self.nulls:], doc_id))
        if frame == len(self.ids) or self.ids[frame] != doc_id:
            raise KeyError(doc_id)
        return self.tokens(frame)


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Writes token files in ascending id order and returns their manifest.

    The manifest has a row per file: range (the files' order), path, wide, n_docs, n_ids. Null texts
    are empty documents; rows that repeat an id are documents of their own, in the order of a
    hash of their text. Documents without an id come first, with that marked. An empty table
    writes no file.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    wide = Tokenizer.from_file(tokenizer).get_vocab_size() > 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(tokenizer)
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        name, writer, n_ids, stream, place = f"{uuid.uuid4().hex}.zst", None, 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                stream, place = files.open_output_stream(f"{root}/{name}", compression=None), batch.column(2)[0].as_py()
                writer = FrameWriter(stream, wide)
            texts = (x or "" for x in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                writer.add(doc_id, np.append(ids, np.int32(end_id)))
                n_ids += len(ids) + 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({
                "range": [place], "path": [f"{folder.rstrip('/')}/{name}"], "wide": [wide],
                "n_docs": [len(writer.ids)], "n_ids": [n_ids],
            })

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    ranges = chosen.repartitionByRange(partitions(spark), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranges = ranges.withColumn("range", F.spark_partition_id().cast("bigint"))
    return store(ranges.mapInArrow(run, "range bigint, path string, wide boolean, n_docs bigint, n_ids bigint"))


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it in the order of the files. The manifest
    has one row per file. A task reads a slice of a file's frames through its seek table.
    """
    files = manifest.withColumn(
        "base", F.coalesce(F.sum("n_ids").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slices = files.select(
        "path", "wide", "base",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(FRAMES_AT_ONCE).cast("bigint"))).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, wide, base, first in batch.itertuples(index=False):
                files, place = _file_system(path)
                with files.open_input_file(place) as file:
                    reader = FrameReader(file, wide)
                    width = 4 if wide else 2
                    starts = base + (np.cumsum(reader.raw_sizes) - reader.raw_sizes) // width
                    chosen = range(first, min(first + FRAMES_AT_ONCE, len(reader.ids)))
                    crcs = [zlib.crc32(reader.tokens(i).astype("<u4").tobytes()) for i in chosen]
                    ids = pd.array(reader.ids[chosen.start:chosen.stop], "Int64")
                    ids[:max(0, reader.nulls - chosen.start)] = pd.NA
                    yield pd.DataFrame({
                        "doc_id": ids, "start": starts[chosen.start:chosen.stop],
                        "n_tokens": reader.raw_sizes[chosen.start:chosen.stop] // width, "ids_crc32": crcs,
                    })

    spread = slices.repartition(partitions(spark), "path", "first")
    return spread.mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer, new_folder(spark, "token-files"), end_id))

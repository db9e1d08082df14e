"""Helpers of this subpackage: word patterns, ranks over hot groups, inline tables."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of characters other than space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of known bound as a literal: no files, no Python on the executors."""
    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def ranked(df: DataFrame, group: str, spread: list[str], order: list[str], name: str, buckets: int) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of ``group``, in no wanted order.

    A group may hold a third of all rows. Its rows are spread over buckets by a hash of
    ``spread``; the ranks run inside a bucket, after the counts of the buckets before it.
    The hash and ``order`` settle each rank, so a recomputed task gives the same one; rows
    equal in all of ``order`` are interchangeable.
    """
    bucket, before = f"{name}_bucket", f"{name}_before"
    df = df.withColumn(bucket, F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, bucket).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(group, bucket).orderBy(*order)
    return (
        df.join(offsets, [group, bucket])
        .withColumn(name, F.col(before) + F.row_number().over(inside) - 1)
        .drop(bucket, before)
    )


def lean(run: Callable[[Iterator], Iterator], *tables: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``run`` for a map over batches; at a task's end its Python worker empties ``tables`` and returns freed memory to the machine.

    Workers outlive their tasks, and their allocators keep what tasks freed; an executor's other processes need it.
    """
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)  # its frame, and all it held, is gone after this
        finally:
            for empty in tables:
                empty()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps its memory
                pass

    return wrapped

"""Isotonic calibration of tables that no single task can hold.

Pool-adjacent-violators is mergeable: pooling each range of scores to blocks, and then the
blocks of neighbouring ranges, gives the blocks of the whole. Rows collapse to distinct scores
first; ranges of scores pool where range partitioning puts them; then ``FAN`` neighbours at a
time merge, level by level, until one range per group is left. What moves between levels is
blocks alone. Labels of 0 and 1 over n rows leave at most about n^(2/3) of them, and only one
group's blocks ever meet in a task, so any number of groups is fitted by the same few jobs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.session import store

FAN = 8


def _pooled(keys: int):
    """A mapInArrow function: rows sorted by ``keys`` key columns, then lo; a run of equal keys is pooled to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, blocks = None, []  # blocks of the current key: [lo, hi, total, weight], means rise strictly

        def emit(schema: pa.Schema) -> pa.RecordBatch:
            columns = [[k] * len(blocks) for k in current] + [list(c) for c in zip(*blocks, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for key, lo, hi, total, weight in zip(
                    zip(*columns[:keys], strict=True) if keys else [()] * batch.num_rows, *columns[keys:], strict=True):
                if key != current:
                    if blocks:
                        yield emit(schema)
                    current, blocks = key, []
                while blocks and blocks[-1][2] / blocks[-1][3] >= total / weight:
                    lo, _, more, heavy = blocks.pop()
                    total, weight = total + more, weight + heavy
                blocks.append((lo, hi, total, weight))
        if blocks:
            yield emit(schema)

    return run


def isotonic_blocks(rows: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None,
                    ranges: int | None = None) -> DataFrame:
    """The isotonic fit of label on score within each group: by, lo, hi, value, weight.

    A row per block of scores lo to hi with one fitted value; values rise strictly. Rows
    without a score or label, NaN scores and rows of weight 0 or less are left out; equal scores share
    one value. Null groups are a group. An empty table has no block.
    """
    by = list(by)
    spark = rows.sparkSession
    heavy = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = F.col(score).cast("double")
    points = rows.where(x.isNotNull() & ~F.isnan(x) & F.col(label).isNotNull() & (heavy > 0)).select(
        *by, x.alias("lo"), (F.col(label).cast("double") * heavy).alias("total"), heavy.alias("weight"))
    points = points.groupBy(*by, "lo").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = points.select(*by, "lo", F.col("lo").alias("hi"), "total", "weight")
    placed = points.repartitionByRange(ranges, *by, "lo").withColumn("range", F.spark_partition_id())
    columns = ["range", *by, "lo", "hi", "total", "weight"]
    placed = placed.sortWithinPartitions(*by, "lo").select(*columns)
    blocks = store(placed.mapInArrow(_pooled(len(by) + 1), placed.schema))
    while ranges > 1:
        ranges = -(-ranges // FAN)
        merged = blocks.withColumn("range", F.floor(F.col("range") / FAN).cast("int"))
        merged = merged.repartition(*[F.col(c) for c in (*by, "range")]).sortWithinPartitions(*by, "range", "lo").select(*columns)
        blocks = store(merged.mapInArrow(_pooled(len(by) + 1), merged.schema))
    return blocks.select(*by, "lo", "hi", (F.col("total") / F.col("weight")).alias("value"), "weight")


def calibrators(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row per group: boundaries and predictions, as ``recalibrated_scores`` and Spark ML read them."""
    ends: Column = F.when(F.col("lo") == F.col("hi"), F.array("lo")).otherwise(F.array("lo", "hi"))
    ordered = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lo", ends.alias("x"), "value"))).alias("b"))
    return ordered.select(
        *by, F.flatten(F.transform("b", lambda r: r["x"])).alias("boundaries"),
        F.flatten(F.transform("b", lambda r: F.transform(r["x"], lambda _: r["value"]))).alias("predictions"))


def as_model(spark: SparkSession, boundaries: Sequence[float], predictions: Sequence[float]) -> IsotonicRegressionModel:
    """A Spark ML model of finished blocks: linear between boundaries, flat outside; it saves and loads like a fitted one."""
    jvm = spark.sparkContext._jvm
    old = jvm.org.apache.spark.mllib.regression.IsotonicRegressionModel(
        [float(x) for x in boundaries], [float(y) for y in predictions], True)
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("isoReg")
    return IsotonicRegressionModel(jvm.org.apache.spark.ml.regression.IsotonicRegressionModel(uid, old))


def fit_isotonic(scored: DataFrame, score: str = "raw", label: str = "label") -> IsotonicRegressionModel:
    """A calibrator from (score, label) rows; only its final blocks reach the driver."""
    found = calibrators(isotonic_blocks(scored, score, label), []).first()
    return as_model(scored.sparkSession, found["boundaries"] or [], found["predictions"] or [])

"""Exact running totals, ranks and quantiles over orders that span many tasks.

A window ordered over a whole tenant would put that tenant into one task. Here the order is
cut into buckets first: approximate quantiles give the cut values, every cut value is a
bucket of its own, and the open range between two cut values holds about 1/buckets of the
rows. Rows that tie on one value are spread further by the tie-break column. Totals per
bucket give each bucket its offset; the window then only runs inside a bucket. The bucket
depends on the value alone, so a recomputed task puts a row where it was before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import takewhile

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from leadlake.session import store

BUCKETS = 256
SALTS = 64


def _cuts(df: DataFrame, columns: Sequence[str], buckets: int) -> list[list[float]]:
    """Cut values per column, from one pass over the rows; columns after the first get a quarter of them."""
    if not columns:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    numbers = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    found = numbers.approxQuantile([f"v{i}" for i in range(len(columns))], probabilities, 1.0 / (4 * buckets))
    few = max(buckets // 4, 2)
    steps = [1] + [max(1, buckets // few)] * (len(columns) - 1)
    return [sorted({v for v in values[step - 1::step] if math.isfinite(v)}) for values, step in zip(found, steps, strict=True)]


def _bucketed(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """Adds ``name``: 2i for the open range above cut i, 2i-1 for the cut value itself."""
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    raw, value = f"{name}_raw", f"{name}_value"
    splits = [-math.inf, *cuts, math.inf]
    df = df.withColumn(value, F.col(column).cast("double"))
    df = Bucketizer(splits=splits, inputCol=value, outputCol=raw).transform(df)
    place = F.col(raw).cast("int")
    # One expression string: building hundreds of literal columns one by one is slow.
    listed = F.expr(f"array({', '.join(f'{c!r}D' for c in cuts)})")
    at_cut = F.get(listed, place - 1) == F.col(value)
    code = place * 2 - F.when(at_cut, 1).otherwise(0)
    return df.withColumn(name, code.cast("bigint")).drop(raw, value)


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def running_totals(
    df: DataFrame, order: Sequence[str], totals: Sequence[str], by: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> DataFrame:
    """Adds ``<c>_before`` and ``<c>_total`` for every column c of ``totals``.

    ``order`` lists columns, most significant first; a leading ``-`` means descending.
    ``<c>_before`` sums c over the rows ahead within ``by``, ``<c>_total`` over all rows of
    ``by``. Order columns must not be null, must be unique together within ``by``, and the
    first must be numeric (a later text column orders rows but adds no buckets). ``by``
    columns must not be null.
    """
    by = list(by)
    if buckets == BUCKETS:  # the default grows with the cluster; the number does not change answers
        buckets = max(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parsed = [(name.lstrip("-"), name.startswith("-")) for name in order]
    coded, codes = df, []
    leading = [name for name, _ in takewhile(lambda x: _is_number(df, x[0]), parsed)]
    for level, (name, cuts) in enumerate(zip(leading, _cuts(df, leading, buckets), strict=True)):
        code = f"_code{level}"
        coded = _bucketed(coded, name, cuts, code)
        if codes:
            # Only where all rows share one value of the columns before may the next
            # column cut further; an open range is ordered by its own column first.
            tied = F.col(codes[0]) % 2 != 0
            for c in codes[1:]:
                tied = tied & (F.col(c) % 2 != 0)
            coded = coded.withColumn(code, F.when(tied, F.col(code)).otherwise(0))
        codes.append(code)
    for code, (_, descending) in zip(codes, parsed):
        if descending:
            coded = coded.withColumn(code, -F.col(code))

    keys = by + codes
    in_order = [F.col(n).desc() if descending else F.col(n).asc() for n, descending in parsed]
    inside = Window.partitionBy(*keys).orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)

    # One row per bucket and group: a small table whatever the row count.
    across = Window.partitionBy(*by).orderBy(*codes)
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = coded.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in totals]).select(
        *keys,
        *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}_offset") for c in totals],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in totals],
    )
    out = coded.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_{c}_inside") for c in totals]
    ).join(offsets, keys)
    for c in totals:
        out = out.withColumn(f"{c}_before", F.col(f"_{c}_inside") + F.col(f"_{c}_offset"))
    return out.drop(*codes, *[f"_{c}_inside" for c in totals], *[f"_{c}_offset" for c in totals])


def global_rank(df: DataFrame, order: Sequence[str], by: Sequence[str] = (),
                buckets: int = BUCKETS) -> DataFrame:
    """Adds ``rank`` 1..n and ``rows`` = n within ``by``; ``order`` as in running_totals."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, ["_one"], by,
                             buckets)
    return (
        counted.withColumn("rank", F.col("_one_before") + 1)
        .withColumn("rows", F.col("_one_total"))
        .drop("_one", "_one_before", "_one_total")
    )


def top_rows(df: DataFrame, order: Sequence[Column], n: int | str, by: Sequence[str], salt_on: str,
             name: str = "rank", salts: int = SALTS) -> DataFrame:
    """The first n rows of each group, numbered 1..n in ``name``; ``order`` must be total.

    ``n`` is a number, or the name of a column that holds the number of the row's group.

    Every map task keeps n rows of a group, but a heavy group has very many map tasks, and
    all of their rows would meet in one reducer. So the survivors are first cut to n per
    (group, salt) in parallel; the last step then sees at most salts * n rows of a group.
    """
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn(name, F.row_number().over(first)).where(F.col(name) <= limit).drop(name, "_salt")
    last = Window.partitionBy(*by).orderBy(*order)
    out = kept.withColumn(name, F.row_number().over(last)).where(F.col(name) <= limit)
    return out.withColumn(name, F.col(name).cast("bigint"))


def count_values(values: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct non-null value, stored: what an order over values is built from."""
    return store(
        values.where(F.col(value).isNotNull())
        .groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    )


def quantiles_of_counts(counts: DataFrame, value: str, probabilities: Sequence[float],
                        by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Quantiles with linear interpolation from (by, value, n) rows."""
    by = list(by)
    placed = running_totals(counts.withColumnRenamed(value, "_value"), ["_value"], ["n"], by, buckets)
    wanted = placed.withColumn(
        "probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    position = F.col("probability") * (F.col("n_total") - 1)
    low, first, last = F.floor(position), F.col("n_before"), F.col("n_before") + F.col("n") - 1
    high = F.ceil(position)
    hit = wanted.where(((low >= first) & (low <= last)) | ((high >= first) & (high <= last)))
    ends = hit.groupBy(*by, "probability").agg(
        F.min("_value").alias("_low"), F.max("_value").alias("_high"),
        F.first(position - low).alias("_part"),
    )
    return ends.select(
        *by, "probability",
        (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"),
    )


def exact_quantiles(values: DataFrame, value: str, probabilities: Sequence[float],
                    by: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles: one row per group and probability (by, probability, quantile).

    Only distinct values with their counts are ordered, so neither heavy ties nor a heavy
    group ends up in one buffer.
    """
    return quantiles_of_counts(count_values(values, value, by), value, probabilities, by, buckets)

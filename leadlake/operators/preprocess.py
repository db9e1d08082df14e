"""Feature vectors from clean frames: imputing, scaling and one-hot encoding.

Numbers need three scalars each. Levels live in a stored dictionary table (feature, value,
slot), however many there are: fitting counts them in one distributed pass, numbers them in
the order of their md5, which spreads any feature over many tasks, and only a count per
feature reaches the driver. Applying joins one slice of the dictionary per feature; Catalyst
broadcasts a slice whose files are small and shuffles by value otherwise. Vectors are built
by Spark ML's own encoder and assembler, sparse, without level names in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake import schema, settings as S
from leadlake.operators.clean import baseline_row, category_counts
from leadlake.session import store


def level_slots(counts: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Adds ``slot`` 0, 1, ... to the distinct values of each group, in the order of their md5.

    Leading digits of the md5 are buckets; the window runs inside a bucket, after the counts of the buckets before.
    """
    by = list(by)
    coded = counts.withColumn("_md5", F.md5(F.col("value").cast("binary"))).withColumn("_bucket", F.substring("_md5", 1, 3))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = coded.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))  # 4,096 rows a group at most
    sizes = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_md5", "value")
    ranked = coded.join(sizes, [*by, "_bucket"]).withColumn("slot", (F.col("_before") + F.row_number().over(inside) - 1).cast("int"))
    return ranked.drop("_md5", "_bucket", "_before")


@dataclass
class Preprocessor:
    """Imputes, standardises and one-hot encodes clean frames into ``features``.

    ``passthrough`` names numeric columns that enter as they are (already encoded data). A
    vector holds the scaled numbers, then per encoded feature a slot for each frequent level and one that
    infrequent and unseen levels share, then the passthrough columns.
    """

    numeric: list[str]
    categorical: list[str]
    passthrough: list[str] = field(default_factory=list)
    scale: dict[str, list[float]] = field(default_factory=dict)  # feature: what fills it, mean, spread
    sizes: dict[str, int] = field(default_factory=dict)  # encoded feature: its slots
    levels: DataFrame | None = None  # stored: feature, value, slot

    @property
    def width(self) -> int:
        """Length of the vectors."""
        return len(self.numeric) + sum(self.sizes.values()) + len(self.passthrough)

    def fit(self, clean: DataFrame) -> Preprocessor:
        if self.numeric:
            baseline = baseline_row(clean, numeric=self.numeric, categorical=[]).first()
            filled = {c: F.coalesce(F.col(c), F.lit(baseline[c])) for c in self.numeric}
            stats = clean.select(*[x for c, v in filled.items() for x in (
                F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"))]).first()
            self.scale = {c: [baseline[c], stats[f"{c}_mean"] or 0.0, stats[f"{c}_std"] or 1.0] for c in self.numeric}
        if self.categorical:
            named = clean.select(*[F.coalesce(F.col(c), F.lit(schema.UNKNOWN)).alias(c) for c in self.categorical])
            frequent = category_counts(named, self.categorical).where(F.col("n") >= S.INFREQUENT_LEVEL_ROWS)
            self.levels = store(level_slots(frequent).select("feature", "value", "slot"))
            found = self.levels.groupBy("feature").agg(
                F.count(F.lit(1)).alias("n"), F.bool_or(F.col("value") != schema.UNKNOWN).alias("tells")).collect()  # a row per feature
            sizes = {r["feature"]: r["n"] + 1 for r in found if r["n"] > 1 or r["tells"]}
            self.sizes = {c: sizes[c] for c in self.categorical if c in sizes}
        return self

    def apply(self, clean: DataFrame) -> DataFrame:
        """``clean`` with ``features``."""
        made = clean
        for c, n in self.sizes.items():
            value, slot = f"_{c}_value", f"_{c}_slot"
            part = self.levels.where(F.col("feature") == c).select(F.col("value").alias(value), F.col("slot").alias(slot))
            made = made.join(part, F.coalesce(F.col(c), F.lit(schema.UNKNOWN)) == F.col(value), "left").drop(value)
        scaled = [((F.coalesce(F.col(c), F.lit(fill)) - mean) / spread).alias(f"_{c}_z") for c, (fill, mean, spread) in self.scale.items()]
        slots = [F.coalesce(f"_{c}_slot", F.lit(n - 1)).cast("double").alias(f"_{c}_i", metadata=_attributes(type="nominal", num_vals=n))
                 for c, n in self.sizes.items()]
        made = made.select(*clean.columns, *scaled, *slots)
        parts = [f"_{c}_z" for c in self.numeric]
        if self.sizes:
            inputs, outputs = [f"_{c}_i" for c in self.sizes], [f"_{c}_hot" for c in self.sizes]
            hot = OneHotEncoder(inputCols=inputs, outputCols=outputs, dropLast=False).fit(made)  # sizes come from the attributes
            made = hot.transform(made).select(
                *clean.columns, *parts, *[F.col(f"_{c}_hot").alias(f"_{c}_hot", metadata=_attributes(num_attrs=n)) for c, n in self.sizes.items()])
            parts += outputs
        made = VectorAssembler(inputCols=parts + self.passthrough, outputCol="features").transform(made)
        return made.select(*clean.columns, F.col("features").alias("features", metadata=_attributes(num_attrs=self.width)))

    def save(self, path: str) -> dict[str, Any]:
        """Writes the dictionary under ``path`` and returns the rest, for JSON."""
        if self.levels is not None:
            self.levels.write.mode("overwrite").parquet(f"{path}/levels")
        return {"numeric": self.numeric, "categorical": self.categorical, "passthrough": self.passthrough,
                "scale": self.scale, "sizes": self.sizes, "levels": self.levels is not None}

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict[str, Any]) -> Preprocessor:
        known = {k: v for k, v in facts.items() if k != "levels"}
        return Preprocessor(**known, levels=spark.read.parquet(f"{path}/levels") if facts["levels"] else None)


def _attributes(**about: Any) -> dict[str, Any]:
    return {"ml_attr": about}

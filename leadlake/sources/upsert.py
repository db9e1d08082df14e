"""Keeping the lead table: merge by (source_id, external_id), change log, run log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake import schema, settings as S
from leadlake.functions.text import coerce_bool, to_number
from leadlake.operators.ranks import top_rows

KEY = ("source_id", "external_id")
# Replaced as a whole by a newer record / kept unless the newer record has a value.
STICKY = ("display_name", "converted", "converted_at", "deal_value")

LEAD_STRUCT = T.StructType([
    T.StructField("tenant_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("display_name", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("converted", T.BooleanType()),
    T.StructField("converted_at", T.TimestampType()),
    T.StructField("deal_value", T.DoubleType()),
    T.StructField("updated_at", T.TimestampType()),
])


def lead_rows(canonical: DataFrame, updated_at: Column) -> DataFrame:
    """Canonical text columns plus tenant_id and source_id as rows of the lead table.

    A record without an id gets one from its source and content, so the same record always
    meets itself again. Personal fields stay out of the payload.
    """
    types = dict(canonical.dtypes)
    fields = [c for c in canonical.columns if c in schema.FIELD_NAMES]
    body = [c for c in fields if c != "external_id"]
    everything = F.to_json(F.struct(*fields))
    made_up = F.concat(F.col("source_id"), F.lit("-"), F.sha2(everything, 256))
    given = F.col("external_id").cast("string") if "external_id" in fields else F.lit(None).cast("string")
    payload = [x for c in body for x in (F.lit(c), F.col(c).cast("string"))]
    has = lambda c, make, t: (make() if c in fields else F.lit(None)).cast(t)
    out = canonical.select(
        "tenant_id", "source_id",
        F.coalesce(F.when(given != "", given), made_up).alias("external_id"),
        has("display_name", lambda: F.nullif(F.col("display_name"), F.lit("")), "string").alias("display_name"),
        (F.map_filter(F.create_map(*payload), lambda _, v: v.isNotNull()) if payload
         else F.lit(None).cast("map<string,string>")).alias("payload"),
        has("converted", lambda: coerce_bool(F.col("converted")), "boolean").alias("converted"),
        has("converted_at", lambda: F.col("converted_at").try_cast("timestamp"), "timestamp").alias("converted_at"),
        has("deal_value", lambda: to_number(F.col("deal_value"), types.get("deal_value", "string")), "double").alias("deal_value"),
        updated_at.alias("updated_at"),
    )
    return out.withColumn(
        "payload", F.map_filter("payload", lambda k, _: ~F.lower(k).isin(*S.PII_FIELDS)))


def newest_per_key(changes: DataFrame, order: str = "ord") -> DataFrame:
    """Fold changes to one row per lead: last payload, last non-null of each sticky column.

    Aggregates only, so a lead that changed very often is merged map-side.
    """
    rest = [c for c in changes.columns if c not in (*KEY, *STICKY, order)]
    return changes.groupBy(*KEY).agg(
        *[F.max_by(c, order).alias(c) for c in rest],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in STICKY],
        F.max(order).alias(order),
    )


def upsert_leads(target: DataFrame, batch: DataFrame, order: str = "ord") -> DataFrame:
    """The lead table after a batch. ``batch`` may hold a key several times (``order``).

    Adds ``is_new`` and ``touched``. New payloads replace old ones; the sticky columns are
    only overwritten by values.
    """
    news = newest_per_key(batch, order).drop(order)
    old = target.alias("o")
    joined = old.join(news.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full_outer")
    here, there = F.col("n.external_id").isNotNull(), F.col("o.external_id").isNotNull()
    columns = []
    for c in target.columns:
        if c in KEY or c in STICKY:
            columns.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in news.columns:
            columns.append(F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            columns.append(F.col(f"o.{c}").alias(c))
    return joined.select(*columns, (here & ~there).alias("is_new"), here.alias("touched"))


def match_existing(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Batch rows with ``exists``: whether the lead is stored already."""
    known = target.select(*KEY).withColumn("_known", F.lit(True))
    return batch.join(known, list(KEY), "left").withColumn(
        "exists", F.coalesce("_known", F.lit(False))).drop("_known")


def sync_counts(target: DataFrame, batch: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """fetched, created (new keys) and updated (all other rows) per source."""
    keys = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    marked = match_existing(target, keys)
    counted = marked.groupBy(*by).agg(F.sum("n").alias("fetched"), F.count_if(~F.col("exists")).alias("created"))
    return counted.withColumn("updated", F.col("fetched") - F.col("created"))


class LeadStore:
    """Leads as a change log over a base in hash slots, on plain parquet.

    ``changes/batch_id=N`` holds what batch N brought. The base is one file or more per slot of
    the key's hash, about ``rows_per_file`` rows each; ``manifest/upto=N`` lists the files of
    the base that folds the batches up to N. A batch therefore finds its leads by their slots: ``rows_of`` opens the files
    of those slots and no others. ``compact`` rewrites the slots that changes touched and takes over the other files, so it costs
    what changed; when the leads outgrow the slots, it deals them over more. Nothing that is being read is ever
    overwritten, and a batch overwrites its own folder alone, so a retried one changes nothing.

    The last record of a lead wins: by batch, then by ``position`` inside the batch.
    """

    def __init__(self, spark: SparkSession, root: str, rows_per_file: int = 250_000) -> None:
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file

    def append(self, rows: DataFrame, batch_id: int, position: Column | None = None) -> None:
        """``position`` orders the records of the batch (a source's time or line number). By default it
        is a hash of their content: without meaning, but the same on every retry."""
        names = [f.name for f in LEAD_STRUCT]
        place = F.xxhash64(F.to_json(F.struct(*names))) if position is None else position.cast("bigint")
        rows.withColumn("position", place).select(*names, "position").write.mode("overwrite").parquet(
            f"{self.root}/changes/batch_id={batch_id}")

    def _read(self, part: str, kind: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(kind).parquet(f"{self.root}/{part}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in (error.getCondition() or ""):
                return None
            raise

    def _manifest(self) -> tuple[int, int, DataFrame | None]:
        """(last batch in the base, number of slots, files): -1, 1 and None without a base."""
        kind = T.StructType([T.StructField(n, T.LongType()) for n in ("slot", "slots", "rows")]
                            + [T.StructField("path", T.StringType()), T.StructField("upto", T.LongType())])
        files = self._read("manifest", kind)
        newest = None if files is None else files.agg(F.max(F.struct("upto", "slots")).alias("m")).first()["m"]
        if newest is None:
            return -1, 1, None
        return newest["upto"], newest["slots"], files.where(F.col("upto") == newest["upto"])

    def _changes(self, after: int, before: int | None = None) -> DataFrame | None:
        kind = T.StructType([*LEAD_STRUCT, T.StructField("position", T.LongType()), T.StructField("batch_id", T.LongType())])
        changes = self._read("changes", kind)
        if changes is None:
            return None
        inside = F.col("batch_id") > after
        inside = inside if before is None else inside & (F.col("batch_id") < before)
        return changes.where(inside).withColumn("ord", F.struct(F.col("batch_id").alias("batch"), "position")).drop("batch_id", "position")

    def _base(self, files: DataFrame | None) -> DataFrame | None:
        """The rows of some files of the manifest; their paths, at most one per ``rows_per_file`` leads, pass the driver."""
        paths = [] if files is None else [r["path"] for r in files.select("path").collect()]
        if not paths:
            return None
        kind = T.StructType([*LEAD_STRUCT, T.StructField("batch", T.LongType()), T.StructField("position", T.LongType())])
        return self.spark.read.schema(kind).parquet(*paths).withColumn("ord", F.struct("batch", "position")).drop("batch", "position")

    def _folded(self, parts: Sequence[DataFrame | None]) -> DataFrame:
        held = [p for p in parts if p is not None]
        if not held:
            return self.spark.createDataFrame([], LEAD_STRUCT)
        rows = held[0]
        for part in held[1:]:
            rows = rows.unionByName(part)
        return newest_per_key(rows).select(*[f.name for f in LEAD_STRUCT])

    @staticmethod
    def _slot(slots: int) -> Column:
        return F.pmod(F.xxhash64(*KEY), F.lit(slots))

    def current(self) -> DataFrame:
        """All leads as they stand."""
        last, _, files = self._manifest()
        return self._folded([self._base(files), self._changes(last)])

    def rows_of(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The leads of ``keys`` (source_id, external_id) as they stand, or stood before a batch that has been appended.

        Of the base only the files of the keys' slots are opened. A batch in the base already stays in it.
        """
        keys = keys.select(*KEY).distinct()
        last, slots, files = self._manifest()
        if files is not None:
            touched = keys.select(self._slot(slots).alias("slot")).distinct()
            files = files.join(touched, "slot", "left_semi")
        parts = [self._base(files), self._changes(last, before)]
        return self._folded([None if p is None else p.join(keys, list(KEY), "left_semi") for p in parts])

    def compact(self) -> None:
        """Folds newer batches into the base, if there are any."""
        last, slots, files = self._manifest()
        changes = self._changes(last)
        newest = None if changes is None else changes.agg(F.max("ord.batch"), F.count(F.lit(1))).first()
        if newest is None or newest[0] is None:
            return
        upto, more = newest
        known = 0 if files is None else files.agg(F.sum("rows")).first()[0]
        kept = None
        if files is not None and known + more <= 2 * slots * self.rows_per_file:
            touched = changes.select(self._slot(slots).alias("slot")).distinct()
            kept, files = files.join(touched, "slot", "left_anti"), files.join(touched, "slot", "left_semi")
        else:
            slots = 1
            while slots * self.rows_per_file < known + more:
                slots *= 2
        parts = min(slots, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-(known + more) // self.rows_per_file)))
        folded = self._folded([self._base(files), changes]).withColumn("slot", self._slot(slots))
        folded = folded.withColumns({"batch": F.lit(upto).cast("bigint"), "position": F.lit(0).cast("bigint")})
        path = f"{self.root}/base/upto={upto}"
        folded.repartition(parts, "slot").sortWithinPartitions("slot", *KEY).write.mode("overwrite").partitionBy("slot").parquet(path)
        written = self.spark.read.parquet(path).groupBy(F.col("slot").cast("bigint").alias("slot"), F.col("_metadata.file_path").alias("path")).agg(
            F.count(F.lit(1)).alias("rows"))
        written = written.select("slot", F.lit(slots).cast("bigint").alias("slots"), "rows", "path")
        if kept is not None:
            written = written.unionByName(kept.drop("upto"))
        written.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/upto={upto}")


# ------------------------------------------------------------------ append-only logs


def sync_run_rows(counts: DataFrame, status: DataFrame, started_at: Column, finished_at: Column) -> DataFrame:
    """One run row per source: blocked or failed sources have zero counts and an error."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return status.join(counts, "source_id", "left").select(
        "source_id", F.when(F.col("status") == "ready", "success").otherwise(F.col("status")).alias("status"),
        n("fetched"), n("created"), n("updated"), "error",
        started_at.alias("started_at"), finished_at.alias("finished_at"))


def audit_rows(rows: DataFrame, action: str, target: str, detail: Sequence[str], created_at: Column,
               actor: str = "system") -> DataFrame:
    tenant = F.col("tenant_id") if "tenant_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        tenant.alias("tenant_id"), F.lit(actor).alias("actor"), F.lit(action).alias("action"),
        F.col(target).cast("string").alias("target"), F.to_json(F.struct(*detail)).alias("detail"),
        created_at.alias("created_at"))


def append_rows(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def sync_history(runs: DataFrame, n: int = 20) -> DataFrame:
    """The last n runs of each source, newest first."""
    return top_rows(runs, [F.desc("started_at"), F.desc("run_id")], n, ["source_id"], "run_id", "row")

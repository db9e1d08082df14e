"""Structured Streaming forms of ingesting, scoring, outcomes and monitoring.

Every job is started with ``availableNow`` and a checkpoint: it takes what has arrived,
remembers where it stopped, and stops. Sinks are written per micro-batch into a folder of
that batch, so a retried batch replaces its own output and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadlake.functions.numbers import bin_by_edges, even_edges, ratio
from leadlake.operators.clean import apply_mapping
from leadlake.operators.decide import matched_outcomes
from leadlake.operators.drift import live_bins, psi
from leadlake.sources.upsert import LeadStore, lead_rows


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet",
                files_per_trigger: int = 1000, glob: str | None = None, **options: str) -> DataFrame:
    """Files landing in a folder as a stream; the checkpoint is the sync cursor."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_ingest(records: DataFrame, mapping: Mapping[str, str], leads: LeadStore, checkpoint: str,
                  updated_at: Column) -> StreamingQuery:
    """Map raw text records onto the schema and append them to the lead store.

    ``records`` has tenant_id, source_id and the source's own columns.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        keyed = {"tenant_id": "tenant_id", "source_id": "source_id", **mapping}
        leads.append(lead_rows(apply_mapping(batch, keyed), updated_at), batch_id)

    return _run(records, each, checkpoint)


def stream_score(leads: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Score each micro-batch and write its log rows to ``path/batch_id=N``."""
    def each(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(leads, each, checkpoint)


def stream_outcomes(outcomes: DataFrame, leads: Callable[[], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Match outcomes to leads as they arrive; ``matched`` tells whether one was found."""
    def each(batch: DataFrame, batch_id: int) -> None:
        found = matched_outcomes(leads(), batch).withColumn("matched", F.col("lead_id").isNotNull())
        found.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _run(outcomes, each, checkpoint)


def stream_intake(rows: DataFrame, moment: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Divides rows as they arrive: ``path/ontime/batch_id=N``, and ``path/late/batch_id=N`` for rows more than ``delay`` behind
    the newest moment of earlier batches, or without a moment.

    A later stateful job with at least this delay drops none of the rows on time, so nothing is lost
    unseen. The newest moments are kept in ``path/marks``; a retried batch reads those before it and divides alike.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema("newest timestamp, batch_id bigint").parquet(f"{path}/marks") if batch_id else None
        seen = None if marks is None else marks.where(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        at = F.col(moment)
        late = at.isNull() if seen is None else at.isNull() | (at < F.lit(seen) - F.expr(f"INTERVAL {delay}"))
        batch.where(~late).write.mode("overwrite").parquet(f"{path}/ontime/batch_id={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        newest = batch.agg(F.greatest(F.max(at), F.lit(seen).cast("timestamp")).alias("newest"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    return _run(rows, each, checkpoint)


def outcome_pairs(outcomes: DataFrame, scores: DataFrame, within: str) -> DataFrame:
    """Every outcome with the scores of its lead that were made at most ``within`` before it; batch and streaming alike.

    outcomes: tenant_id, lead_ref, converted, recorded_at; scores: tenant_id, lead_id, external_id,
    probability, created_at. A reference names a lead id or an external id of the tenant. An outcome
    without such a score comes once, with nulls.
    """
    ways = F.array(*[F.struct(F.col(c).alias("_ref"), F.lit(c).alias("matched_by")) for c in ("lead_id", "external_id")])
    sides = scores.select(F.col("tenant_id").alias("_tenant"), "lead_id", "probability", "created_at", F.inline(ways))
    same = (F.col("tenant_id") == F.col("_tenant")) & (F.col("lead_ref") == F.col("_ref"))
    timely = (F.col("created_at") <= F.col("recorded_at")) & (F.col("created_at") >= F.col("recorded_at") - F.expr(f"INTERVAL {within}"))
    return outcomes.join(sides, same & timely, "left_outer").select(
        "tenant_id", "lead_ref", "converted", "recorded_at", "lead_id", "matched_by", "probability", "created_at")


def stream_outcome_pairs(outcomes: DataFrame, scores: DataFrame, path: str, checkpoint: str, delay: str, within: str) -> StreamingQuery:
    """``outcome_pairs`` of two streams, appended to a table.

    Both sides have a watermark of ``delay``, so state is bounded: scores wait ``within`` and the delay for their outcome, an
    outcome without a score is written once no score can come for it. Of outcomes that tell the same of a reference
    (tenant_id, lead_ref, converted, recorded_at) the first counts. Rows behind the watermark are dropped here: divide them off before by ``stream_intake``.
    """
    told = outcomes.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(["tenant_id", "lead_ref", "converted", "recorded_at"])
    return _to_table(outcome_pairs(told, scores.withWatermark("created_at", delay), within), path, checkpoint)


def closed_outcome_pairs(outcomes: DataFrame, scores: DataFrame, within: str, closed_at: Column) -> DataFrame:
    """What the stream has written when its watermark stands at ``closed_at``: all pairs, and outcomes without a score before it."""
    told = outcomes.dropDuplicates(["tenant_id", "lead_ref", "converted", "recorded_at"])
    pairs = outcome_pairs(told, scores, within)
    return pairs.where(F.col("lead_id").isNotNull() | (F.col("recorded_at") < closed_at))


def _to_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )



def window_bin_counts(live: DataFrame, statistics: DataFrame, moment: str, width: str,
                      by: Sequence[str] = ()) -> DataFrame:
    """Rows per (window, group, feature, reference bin); batch and streaming alike."""
    bins = live_bins(live, statistics, by, extra=[moment])
    return bins.groupBy(F.window(moment, width).alias("w"), *by, "feature", "bin_key").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
             *by, "feature", "bin_key", "n")


def stream_drift(live: DataFrame, statistics: DataFrame, moment: str, width: str, delay: str, path: str,
                 checkpoint: str, by: Sequence[str] = ()) -> StreamingQuery:
    """Bin counts of closed windows, appended to a table; rows behind the watermark are left out."""
    return _to_table(window_bin_counts(live.withWatermark(moment, delay), statistics, moment, width, by),
                     path, checkpoint)


def windowed_psi(counts: DataFrame, statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """PSI per window from the counts of ``window_bin_counts``."""
    return psi(statistics, counts.drop("window_end"), ["window_start", *by])


def window_score_bins(scored: DataFrame, moment: str, width: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Rows, score sum, label sum and squared error per (window, group, score bin)."""
    p, y = F.col("probability"), F.col("converted").cast("int")
    binned = scored.where(p.isNotNull() & y.isNotNull()).withColumn("bin", bin_by_edges(p, even_edges(bins)))
    return binned.groupBy(F.window(moment, width).alias("w"), *by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("score_sum"), F.sum(y).alias("positives"),
        F.sum((p - y) * (p - y)).alias("squared_error"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "bin", "n",
             "score_sum", "positives", "squared_error")


def stream_calibration(scored: DataFrame, moment: str, width: str, delay: str, path: str, checkpoint: str,
                       by: Sequence[str] = (), bins: int = 10) -> StreamingQuery:
    return _to_table(window_score_bins(scored.withWatermark(moment, delay), moment, width, by, bins), path, checkpoint)


def windowed_calibration(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rolling calibration error and Brier score per window from ``window_score_bins``."""
    n = F.col("n")
    gap = F.abs(F.col("positives") - F.col("score_sum"))  # = n * |rate - mean score|
    return bins.groupBy("window_start", *by).agg(
        F.sum(n).alias("sample_size"), ratio(F.sum(gap), F.sum(n)).alias("expected_calibration_error"),
        ratio(F.sum("squared_error"), F.sum(n)).alias("brier"),
        ratio(F.sum("positives"), F.sum(n)).alias("observed_rate"),
    )


def closed_windows(counts: DataFrame, newest: Column) -> DataFrame:
    """The windows a stream with watermark ``newest`` has emitted: the batch twin's filter."""
    return counts.where(F.col("window_end") <= newest)

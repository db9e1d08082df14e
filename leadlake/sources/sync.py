"""One sync run over many sources: gate, map, upsert, score, log and run rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake import schema
from leadlake.operators.clean import apply_mapping, clean_frame, mapping_gate
from leadlake.operators.score import heuristic_scores, prediction_rows
from leadlake.session import store
from leadlake.sources.upsert import LeadStore, lead_rows, sync_counts, sync_run_rows


def stored_features(leads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The canonical features of stored leads, read from their payload."""
    spread = leads.select(*keep, *[F.col("payload")[f].alias(f) for f in schema.FEATURES])
    return clean_frame(spread, keep)


def sync_sources(
    records: DataFrame, sources: DataFrame, mapping: Mapping[str, str], leads: LeadStore, batch_id: int, path: str,
    at: Column, score: Callable[[DataFrame], DataFrame] = heuristic_scores, model_version: str = "heuristic",
    model_tier: str = "generic", position: Column | None = None,
) -> DataFrame:
    """Sync ``records`` (tenant_id, source_id and raw columns) as one batch; returns its run rows.

    Sources without a confirmed mapping are blocked and only get a run row. The others are
    mapped and appended to the lead store; every touched lead is scored as it now stands, and
    its log row goes to ``path/predictions/batch_id=N``, the run rows to ``path/runs/batch_id=N``.
    The store opens the files of the batch's leads alone. A retried batch replaces its own folders and
    counts as it did the first time.
    """
    passed, status = mapping_gate(records, sources)
    keyed = {"tenant_id": "tenant_id", "source_id": "source_id", **mapping}
    batch = store(lead_rows(apply_mapping(passed, keyed), at))
    counts = store(sync_counts(leads.rows_of(batch, before=batch_id), batch))
    leads.append(batch, batch_id, position)
    named = leads.rows_of(batch).withColumn("lead_id", F.concat_ws("/", "source_id", "external_id"))
    scored = score(stored_features(named, ["tenant_id", "source_id", "lead_id"]))
    log = prediction_rows(scored, at, F.lit(model_version), F.lit(model_tier), schema.FEATURES)
    log.write.mode("overwrite").parquet(f"{path}/predictions/batch_id={batch_id}")
    sync_run_rows(counts, status, at, F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/runs/batch_id={batch_id}")
    return leads.spark.read.parquet(f"{path}/runs/batch_id={batch_id}")

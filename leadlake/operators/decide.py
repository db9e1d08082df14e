"""From probabilities to a work queue: ranking, lift, thresholds, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake import settings as S
from leadlake.functions import scoring as X
from leadlake.functions.numbers import ratio, round_to
from leadlake.operators.ranks import BUCKETS, global_rank, top_rows


def queue_filter(leads: DataFrame, source_id: str | None = None, band: str | None = None,
                 include_converted: bool = False) -> DataFrame:
    """Scored leads that have not converted, optionally of one source or stored band."""
    out = leads.where(F.col("probability").isNotNull())
    if not include_converted:
        out = out.where(F.coalesce(F.col("converted").cast("int"), F.lit(0)) == 0)
    if source_id:
        out = out.where(F.col("source_id") == source_id)
    if band:
        out = out.where(F.col("band") == band)
    return out


def with_priority(leads: DataFrame, as_of: Column, strategy: str = "expected_value",
                  base_rate: Column | float = S.DEFAULT_BASE_RATE,
                  default_value: Column | float = S.DEFAULT_DEAL_VALUE) -> DataFrame:
    """Adds days_stale, adjusted_probability, expected_value, priority and adjusted_band.

    The band comes from the unrounded adjusted score; the order uses the rounded priority.
    """
    default = default_value if isinstance(default_value, Column) else F.lit(float(default_value))
    p = F.coalesce(F.col("probability"), F.lit(0.0))
    staged = leads.withColumn("_days", X.days_since(F.col("scored_at"), as_of))
    staged = staged.withColumn("_adjusted", X.apply_decay(p, F.col("_days"), base_rate))
    adjusted, value = F.col("_adjusted"), F.col("deal_value")
    ev = X.expected_value(adjusted, value, default)
    return staged.withColumns({
        "adjusted_probability": round_to(adjusted, 4),
        "expected_value": round_to(ev, 2),
        "priority": round_to(X.priority(strategy, adjusted, value, default), 4),
        "adjusted_band": X.band(adjusted),
        "days_stale": round_to(F.col("_days"), 2),
    }).drop("_days", "_adjusted")


def rank_leads(leads: DataFrame, as_of: Column, strategy: str = "expected_value",
               capacity: int | str | None = S.DEFAULT_DAILY_CAPACITY,
               base_rate: Column | float = S.DEFAULT_BASE_RATE,
               default_value: Column | float = S.DEFAULT_DEAL_VALUE,
               by: Sequence[str] = ("tenant_id",), id_column: str = "lead_key",
               buckets: int = BUCKETS) -> DataFrame:
    """Rank 1..n per group by (rounded priority desc, probability desc, id).

    ``capacity`` is a number, the name of a column holding that of the row's group, or
    None to rank everything. With a capacity only that many rows of a group leave each task;
    without one the order is spread over buckets. A heavy group is split either way.
    """
    placed = with_priority(leads, as_of, strategy, base_rate, default_value)
    if capacity is None:
        return global_rank(placed, ["-priority", "-probability", id_column], by, buckets).drop("rows")
    order = [F.desc("priority"), F.desc("probability"), F.asc(id_column)]
    return top_rows(placed, order, capacity, by, id_column)


def queue_summary(ranked: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    bands = [name for _, name in S.BAND_FLOORS] + [S.LOWEST_BAND]
    money = F.col("expected_value").cast("decimal(20,2)")
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(money).cast("double").alias("total_expected_value"),
        *[F.count_if(F.col("adjusted_band") == b).alias(b) for b in bands],
        round_to(F.avg("adjusted_probability"), 4).alias("mean_probability"),
        F.min("adjusted_probability").alias("cutoff_probability"),
    )


def with_tenant_defaults(leads: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds daily_capacity and default_deal_value; a tenant without a row gets the defaults."""
    out = leads.join(tenants.select("tenant_id", "daily_capacity", "default_deal_value"),
                     "tenant_id", "left")
    return out.withColumns({
        "daily_capacity": F.coalesce("daily_capacity", F.lit(S.DEFAULT_DAILY_CAPACITY)),
        "default_deal_value": F.coalesce("default_deal_value", F.lit(S.DEFAULT_DEAL_VALUE)),
    })


def priority_queue(leads: DataFrame, tenants: DataFrame, models: DataFrame | None, as_of: Column,
                   strategy: str = "expected_value", limit: int | None = None,
                   band: str | None = None, source_id: str | None = None,
                   include_converted: bool = False, candidate_limit: int | None = None,
                   id_column: str = "lead_key") -> DataFrame:
    """The work queue of every tenant in one job.

    The base rate is the conversion rate of the tenant's active model, then of the shared
    base model, then 0.38. ``candidate_limit`` keeps only the most probable leads before
    ranking, which can lose a large deal; by default all candidates are ranked.
    """
    from leadlake.operators.score import with_active_model

    pool = queue_filter(leads, source_id, band, include_converted)
    if candidate_limit is not None:
        best = [F.desc("probability"), F.asc(id_column)]
        pool = top_rows(pool, best, candidate_limit, ["tenant_id"], id_column, "_n").drop("_n")
    pool = with_tenant_defaults(pool, tenants)
    base: Column | float = S.DEFAULT_BASE_RATE
    if models is not None:
        pool = with_active_model(pool, models)
        rate = F.when(F.col("model_conversion_rate") != 0, F.col("model_conversion_rate"))
        base = F.coalesce(rate, F.lit(S.DEFAULT_BASE_RATE))
    return rank_leads(pool, as_of, strategy, limit if limit is not None else "daily_capacity",
                      base, F.col("default_deal_value"), id_column=id_column)


def score_batch_ranked(scored: DataFrame, id_column: str = "lead_key") -> DataFrame:
    """Batch scores, best first (a range-partitioned sort, not a single task)."""
    shown = scored.select(id_column, round_to(F.col("probability"), 4).alias("probability"),
                          X.band(F.col("probability")).alias("band"))
    return shown.orderBy(F.desc("probability"), F.asc(id_column))


def lead_stats(leads: DataFrame, by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Counts, conversion rate and the training plan of each tenant."""
    converted = F.col("converted").cast("int")
    stats = leads.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count("probability").alias("scored"),
        F.count("converted").alias("labelled"), F.count_if(converted == 1).alias("converted"),
    )
    plan = X.training_plan(F.col("labelled"))
    return stats.select(
        *by, "total", "scored", "labelled", "converted",
        round_to(ratio(F.col("converted"), F.col("labelled")), 4).alias("conversion_rate"),
        *[c.alias(name) for name, c in plan.items()],
    )


def lift_by_decile(df: DataFrame, score: str = "probability", label: str = "converted",
                   by: Sequence[str] = ("tenant_id",), id_column: str = "lead_key",
                   buckets: int = BUCKETS) -> DataFrame:
    """Ten buckets of max(n // 10, 1) rows, best score first.

    The n mod 10 rows left over are in no bucket but count in the base rate; a group
    without positives has no table.
    """
    by = list(by)
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *by, F.col(id_column), F.col(score).alias("_p"), F.col(label).cast("int").alias("_y")
    )
    ranked = global_rank(known, ["-_p", id_column], by, buckets)
    size = F.greatest(F.floor(F.col("rows") / 10), F.lit(1)).cast("bigint")
    decile = F.floor((F.col("rank") - 1) / size).cast("bigint") + 1
    # Left-over rows form an eleventh part: kept for the base rate, dropped from the table.
    parts = ranked.withColumn("decile", F.least(decile, F.lit(11).cast("bigint"))).groupBy(*by, "decile").agg(
        F.count(F.lit(1)).alias("leads"), F.sum("_y").alias("_pos"), F.sum("_p").alias("_score"),
    )
    group = Window.partitionBy(*by)  # at most eleven rows
    base = ratio(F.sum("_pos").over(group), F.sum("leads").over(group))
    rate = ratio(F.col("_pos"), F.col("leads"))
    return parts.withColumn("_base", base).where((F.col("decile") <= 10) & (F.col("_base") > 0)).select(
        *by, "decile", "leads", round_to(rate, 4).alias("conversion_rate"),
        round_to(rate / F.col("_base"), 3).alias("lift"),
        round_to(F.col("_score") / F.col("leads"), 4).alias("mean_score"),
    )


def segment_thresholds(df: DataFrame, segment: str, score: str = "probability",
                       label: str = "converted", by: Sequence[str] = (),
                       min_support: int = 50) -> DataFrame:
    """The cut-off among 0.10 .. 0.90 with the best F1 in each segment.

    One aggregate holds the counts of all seventeen cut-offs; the lowest of equal ones wins
    and a segment without any true positive keeps 0.5.
    """
    p, y = F.col(score), F.col(label).cast("int")
    cutoffs = [i / 20 for i in range(2, 19)]
    counts = []
    for i, cut in enumerate(cutoffs):
        counts += [F.count_if((p >= cut) & (y == 1)).alias(f"_tp{i}"),
                   F.count_if((p >= cut) & (y == 0)).alias(f"_fp{i}")]
    grouped = df.where(p.isNotNull() & y.isNotNull()).groupBy(*by, segment).agg(
        F.count(F.lit(1)).alias("support"), F.count_if(y == 1).alias("_pos"), *counts
    ).where(F.col("support") >= min_support)

    def candidate(i: int) -> Column:
        tp, fp = F.col(f"_tp{i}"), F.col(f"_fp{i}")
        f1 = ratio(tp * 2, tp + fp + F.col("_pos"))
        return F.when(tp > 0, F.struct(f1.alias("f1"), F.lit(-cutoffs[i]).alias("below")))

    best = F.array_max(F.array(*[candidate(i) for i in range(len(cutoffs))]))
    return grouped.withColumn("_best", best).select(
        *by, segment, "support",
        F.coalesce(-F.col("_best.below"), F.lit(S.DECISION_THRESHOLD)).alias("threshold"),
        round_to(F.col("_best.f1"), 6).alias("f1"),
    )


def labelled(leads: DataFrame) -> DataFrame:
    return leads.where(F.col("converted").isNotNull()).withColumn(
        "converted", F.col("converted").cast("int")
    )


def record_outcomes(leads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Leads with outcomes applied; ``outcomes``: tenant_id, lead_ref, converted,
    deal_value, recorded_at.

    ``lead_ref`` is a lead id or, failing that, an external id, within the tenant. The
    latest outcome of a lead wins. ``converted_at`` is cleared by a negative outcome.
    """
    news = matched_outcomes(leads, outcomes).where(F.col("lead_id").isNotNull())
    body = F.struct("converted", "deal_value", "recorded_at")
    latest = news.groupBy("tenant_id", "lead_id").agg(F.max_by(body, "recorded_at").alias("_news"))
    joined = leads.join(latest, ["tenant_id", "lead_id"], "left")
    told = F.col("_news").isNotNull()
    was_at = F.col("converted_at") if "converted_at" in leads.columns else F.lit(None).cast("timestamp")
    return joined.withColumns({
        "converted": F.when(told, F.col("_news.converted").cast("int")).otherwise(F.col("converted").cast("int")),
        "converted_at": F.when(told & (F.col("_news.converted").cast("int") == 1), F.col("_news.recorded_at"))
                         .when(~told, was_at),
        "deal_value": F.coalesce(F.col("_news.deal_value"), F.col("deal_value")),
        "outcome_recorded": told,
    }).drop("_news")


def matched_outcomes(leads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes with ``lead_id`` and ``external_id`` of the lead they name, null if none.

    The leads meet the distinct references, which are few, in one inner join: with a small
    outcome table it is broadcast, and the lead table is not shuffled.
    """
    # A lead id counts before an external id. Several sources of a tenant may share an
    # external id: the smallest lead id is taken.
    names = [F.struct(F.col(c).cast("string").alias("lead_ref"), F.lit(i).alias("_by"), F.col("lead_id"), F.col("external_id"))
             for i, c in enumerate(("lead_id", "external_id"))]
    keys = ["tenant_id", "lead_ref"]
    refs = outcomes.select(*keys).dropna().distinct()
    hits = leads.select("tenant_id", F.inline(F.array(*names))).join(refs, keys)
    found = hits.groupBy(*keys).agg(F.min(F.struct("_by", "lead_id", "external_id")).alias("_found"))
    return outcomes.join(found, keys, "left").select(
        *outcomes.columns, F.col("_found.lead_id").alias("lead_id"), F.col("_found.external_id").alias("external_id"))


def unmatched_outcomes(leads: DataFrame, outcomes: DataFrame) -> DataFrame:
    known = leads.select("tenant_id", F.explode(F.array("lead_id", "external_id")).alias("lead_ref"))
    return outcomes.join(known, ["tenant_id", "lead_ref"], "left_anti")


def matched_predictions(predictions: DataFrame, outcomes: DataFrame,
                        keys: Sequence[str] = ("tenant_id", "lead_id")) -> DataFrame:
    """(score, outcome) pairs with both sides known."""
    known = outcomes.where(F.col("converted").isNotNull()).select(
        *keys, F.col("converted").cast("int").alias("converted"))
    return predictions.where(F.col("probability").isNotNull()).join(known, list(keys))


def recent_per_group(df: DataFrame, moment: str, n: int, by: Sequence[str],
                     id_column: str = "lead_key") -> DataFrame:
    """The n newest rows of each group, newest first; ties by id. Adds ``row``."""
    return top_rows(df.where(F.col(moment).isNotNull()), [F.desc(moment), F.asc(id_column)], n, by,
                    id_column, "row")


def writeback_export(scored: DataFrame, sources: DataFrame, limit: int = 100,
                     id_column: str = "external_id") -> DataFrame:
    """Best scored leads of each source that accepts scores: (source, id, score, band)."""
    able = sources.where(F.col("supports_writeback")).select("source_id")
    pool = scored.where(F.col("probability").isNotNull()).join(able, "source_id", "left_semi")
    top = top_rows(pool, [F.desc("probability"), F.asc(id_column)], limit, ["source_id"], id_column)
    return top.select("source_id", "external_id", round_to(F.col("probability"), 4).alias("probability"),
                      X.band(F.col("probability")).alias("band"))


def writeback_counts(attempted: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows attempted and pushed per source; ``failed`` lists (source_id, external_id)."""
    rows = attempted
    bad = F.lit(0)
    if failed is not None:
        marked = failed.select("source_id", "external_id").distinct().withColumn("_bad", F.lit(1))
        rows = attempted.join(marked, ["source_id", "external_id"], "left")
        bad = F.coalesce(F.col("_bad"), F.lit(0))
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(bad == 0).alias("pushed")
    )


def writeback_report(asked: DataFrame, sources: DataFrame, counts: DataFrame) -> DataFrame:
    """What became of every request to write scores back: source_id, status, attempted, pushed, reason.

    ``asked`` has a source_id a row; ``counts`` is what ``writeback_counts`` returns. A source that cannot take
    scores is refused, an unknown one too, and says why; one without scored leads is done with nothing attempted. Repeated requests are one.
    """
    known = sources.select(F.col("source_id").alias("_known"), "supports_writeback")
    joined = asked.select("source_id").distinct().join(known, F.col("source_id") == F.col("_known"), "left").join(counts, "source_id", "left")
    able = F.coalesce("supports_writeback", F.lit(False))
    reason = (F.when(F.col("_known").isNull(), F.concat("source_id", F.lit(" is not a known source.")))
              .when(~able, F.concat("source_id", F.lit(" is read-only."))))
    n = lambda c: F.when(able, F.coalesce(F.col(c), F.lit(0))).otherwise(0).cast("bigint").alias(c)
    return joined.select("source_id", F.when(able, "done").otherwise("refused").alias("status"), n("attempted"), n("pushed"), reason.alias("reason"))

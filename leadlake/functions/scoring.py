"""Score arithmetic as Column expressions: heuristic, decay, value, bands, next action."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake import settings as S


def heuristic_score(values: dict[str, Column] | None = None) -> Column:
    """Engagement score in [0, 1]; a missing signal counts as 0.

    ``values`` replaces fields by other expressions, which is how a what-if or an ablation
    is scored without a second copy of the row.
    """
    values = values or {}
    total = F.lit(0.0)
    for field, full_at, weight in S.HEURISTIC_TERMS:
        signal = F.coalesce(values.get(field, F.col(field)).cast("double"), F.lit(0.0))
        total = total + F.least(signal / F.lit(full_at), F.lit(1.0)) * F.lit(weight)
    return F.greatest(F.lit(0.0), F.least(total, F.lit(1.0)))


def days_since(ts: Column, as_of: Column) -> Column:
    """Days as a fraction, never negative, null for a null moment."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.when(ts.isNotNull(), F.greatest(micros / F.lit(86400e6), F.lit(0.0)))


def decay_factor(days: Column, half_life: float = S.HALF_LIFE_DAYS, enabled: bool = True) -> Column:
    if not enabled or half_life <= 0:
        return F.lit(1.0)
    return F.when(days.isNull() | (days <= 0), F.lit(1.0)).otherwise(
        F.pow(F.lit(0.5), days / F.lit(float(half_life)))
    )


def apply_decay(
    p: Column, days: Column, base_rate: Column | float = S.DEFAULT_BASE_RATE,
    half_life: float = S.HALF_LIFE_DAYS, enabled: bool = True,
) -> Column:
    """Pull a stale score towards the base rate."""
    base = F.lit(base_rate) if not isinstance(base_rate, Column) else base_rate
    factor = decay_factor(days, half_life, enabled)
    return F.when(factor >= 1.0, p).otherwise(base + (p - base) * factor)


def expected_value(p: Column, deal_value: Column, default: Column) -> Column:
    return p * F.when(deal_value > 0, deal_value).otherwise(default)


def priority(strategy: str, p: Column, deal_value: Column, default: Column) -> Column:
    if strategy == "probability":
        return p
    if strategy == "value":
        value = F.coalesce(F.nullif(deal_value, F.lit(0.0)), default)
        return F.when(p >= S.DECISION_THRESHOLD, value).otherwise(0.0)
    if strategy == "expected_value":
        return expected_value(p, deal_value, default)
    raise ValueError(f"unknown strategy {strategy!r}")


def band(p: Column) -> Column:
    out = None
    for floor, name in S.BAND_FLOORS:
        out = F.when(p >= floor, name) if out is None else out.when(p >= floor, name)
    return out.otherwise(S.LOWEST_BAND)


def decide(p: Column, threshold: float = S.DECISION_THRESHOLD) -> Column:
    return F.when(p >= threshold, 1).otherwise(0)


def decision_label(p: Column) -> Column:
    return F.when(p >= S.DECISION_THRESHOLD, "likely_to_convert").otherwise("unlikely_to_convert")


def tier(n_labels: Column) -> Column:
    out = F.lit(S.LOWEST_TIER)
    for name, floor in S.TIER_FLOORS:
        out = F.when(n_labels >= floor, name).otherwise(out)
    return out


def training_plan(n_labels: Column) -> dict[str, Column]:
    """tier, action, detail and next_tier_at for a count of labelled leads."""
    t = tier(n_labels)
    floors = dict(S.TIER_FLOORS)
    action = (
        F.when(t == "generic", "keep_base_model")
        .when(t == "recalibrated", "recalibrate")
        .otherwise("train_tenant_model")
    )
    ending = (
        F.when(t == "generic", "the shared base model keeps scoring.")
        .when(t == "recalibrated", "base model recalibrated to this pipeline.")
        .otherwise("a dedicated model will be trained.")
    )
    following = (
        F.when(t == "generic", floors["recalibrated"])
        .when(t == "recalibrated", floors["tenant"])
        .when(t == "tenant", floors["continuous"])
    )
    return {
        "tier": t,
        "action": action,
        "detail": F.concat(n_labels.cast("string"), F.lit(" labelled lead(s); "), ending),
        "next_tier_at": following.cast("bigint"),
    }


def opted_out(c: Column) -> Column:
    """True when the lead refused contact; a missing answer is not a refusal."""
    return F.coalesce(F.lower(F.trim(c)).isin(*S.OPT_OUT_WORDS), F.lit(False))


def next_best_action(p: Column, do_not_contact: Column, occupation: Column,
                     last_activity: Column, time_on_site: Column) -> dict[str, Column]:
    """First rule that holds wins; ``rule`` picks both the action and its reason."""
    says = lambda c, word: F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
    rule = (
        F.when(opted_out(do_not_contact), "no_outreach")
        .when((p >= 0.75) & says(occupation, "working"), "call_now/working")
        .when((p >= 0.6) & says(last_activity, "sms"), "call_now/sms")
        .when(p >= 0.5, "personal_email")
        .when(F.coalesce(time_on_site, F.lit(0.0)) > 300, "nurture_sequence")
        .otherwise("monitor")
    )
    reason = None
    for key, text in S.ACTION_REASONS.items():
        reason = F.when(rule == key, text) if reason is None else reason.when(rule == key, text)
    return {
        "action": F.element_at(F.split(rule, "/"), 1),
        "reason": reason,
        "basis": F.lit("rule"),
    }


def what_if_verdict(before: Column, after: Column) -> Column:
    return (
        F.when(after > before, "improves").when(after < before, "worsens").otherwise("no change")
    )

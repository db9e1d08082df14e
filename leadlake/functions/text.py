"""Text and value coercion as Column expressions (no Python runs per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.schema import PLACEHOLDERS
from leadlake.settings import FALSY, SUSPICIOUS_NAME_TOKENS, TRUTHY

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def normalize_key(c: Column) -> Column:
    """Lower case, every run of separators becomes one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def folded(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def null_placeholders(c: Column) -> Column:
    """Unanswered dropdowns become null; every other value stays as it was."""
    return F.when(~folded(c).isin(*PLACEHOLDERS), c)


def to_number(c: Column, dtype: str = "string") -> Column:
    """Parse to DOUBLE or null; NaN counts as missing.

    Text goes through a pattern first because ``try_cast`` also takes ``1f`` and ``nan``.
    """
    if dtype == "boolean":
        return c.cast("double")
    if dtype in ("double", "float"):
        return F.when(~F.isnan(c), c.cast("double"))
    if dtype != "string":
        return c.cast("double")
    text = F.trim(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def coerce_bool(c: Column) -> Column:
    text = folded(c)
    return F.when(text.isin(*TRUTHY), True).when(text.isin(*FALSY), False)


def coerce_label(c: Column, dtype: str = "string") -> Column:
    """0 or 1 from such a number, or from the yes/no words; anything else is null."""
    number = to_number(c, dtype)
    return F.when(number == 0, 0).when(number == 1, 1).otherwise(coerce_bool(c).cast("int"))


def field_label(c: Column) -> Column:
    """``time_on_site_seconds`` -> ``Time on site seconds``."""
    spaced = F.lower(F.regexp_replace(c, "_", " "))
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2)))


def suspicious_name(c: Column) -> Column:
    return F.lower(c).rlike("|".join(SUSPICIOUS_NAME_TOKENS))


def looks_like_timestamp(c: Column) -> Column:
    """Text that reads as an ISO date, optionally with a time."""
    text = F.trim(c)
    return text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}") & text.try_cast("timestamp").isNotNull()


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")

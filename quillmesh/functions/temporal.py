"""Confidence over time. `now` is always given; dates are strings, empty for none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions.exponential import exp


def strict_date(text: Column) -> Column:
    """Midnight of a YYYY-MM-DD calendar date; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def decayed(base: Column, rate: Column, verified: Column, now: Column) -> Column:
    """base * e^(-rate * days since verified), within [0, 1]; no decay without a date or a rate."""
    days = F.greatest((F.unix_micros(now) - F.unix_micros(verified)) / F.lit(86_400_000_000.0), F.lit(0.0))
    return F.when(verified.isNull() | (rate == 0), clamp01(base)).otherwise(clamp01(base * exp(-rate * days)))


def is_valid(valid_from: Column, valid_until: Column, now: Column) -> Column:
    return F.coalesce(now >= valid_from, F.lit(True)) & F.coalesce(now <= valid_until, F.lit(True))


def effective_confidence(base: Column, rate: Column, verified: Column, valid_from: Column, valid_until: Column, now: Column) -> Column:
    return F.when(is_valid(valid_from, valid_until, now), decayed(base, rate, verified, now)).otherwise(F.lit(0.0))


def multiplier(confidence: Column, rate: Column, last_verified: Column, now: Column) -> Column:
    """What a keyword score is multiplied with: the decayed confidence, or the plain one where there is
    nothing to decay by; then zero stands for unset and counts as one."""
    date = strict_date(last_verified)
    plain = F.when(confidence == 0, F.lit(1.0)).otherwise(confidence)
    return F.when(date.isNull() | (rate == 0), plain).otherwise(decayed(confidence, rate, date, now))

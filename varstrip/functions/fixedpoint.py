"""Whole-number arithmetic in fixed-point units.

Spark's ``div`` gives a BIGINT and decimal ``/`` rounds, so division truncates through
the remainder: ``(a - a % b) / b`` is exact on whole decimals and cuts toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varstrip.functions.scalar import is_finite
from varstrip.params import CONFIDENCE_SCALE, VALUE_SCALE

WIDE = "decimal(38,0)"


def wide(x: Column) -> Column:
    return x.cast(WIDE)


def truncated_div(a: Column, b: Column) -> Column:
    """a / b cut toward zero; NULL where b is 0."""
    a, b = wide(a), wide(b)
    safe = F.when(b != 0, b)
    return wide((a - a % safe) / safe)


def mul_div(a: Column, b: Column, c: Column) -> Column:
    """a * b / c cut toward zero."""
    return truncated_div(wide(wide(a) * wide(b)), c)


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def scale_value(value: Column) -> Column:
    """Index points to 1e8 fixed point."""
    return round_half_up(value * F.lit(float(VALUE_SCALE))).cast("bigint")


def unscale_value(scaled: Column) -> Column:
    return scaled.cast("double") / F.lit(float(VALUE_SCALE))


def scale_confidence(confidence: Column) -> Column:
    """Confidence to 1e6 fixed point, clamped; non-finite counts as 0."""
    safe = F.when(is_finite(confidence), confidence).otherwise(F.lit(0.0))
    scaled = round_half_up(safe * F.lit(float(CONFIDENCE_SCALE)))
    return F.greatest(F.lit(0), F.least(F.lit(CONFIDENCE_SCALE), scaled)).cast("bigint")


def deviation_bps(previous: Column, new: Column) -> Column:
    """|new - previous| / previous in whole basis points; 0 where previous is 0."""
    diff = F.abs(wide(new) - wide(previous))
    return F.coalesce(truncated_div(diff * F.lit(10_000), previous), F.lit(0)).cast("bigint")


def liquidation_price(entry: Column, leverage: Column, is_long: Column, threshold: float = 0.8) -> Column:
    """Mark at which the loss reaches ``threshold`` of collateral."""
    move = F.lit(threshold) / F.when(leverage > 0, leverage)
    price = F.when(is_long, entry * (F.lit(1.0) - move)).otherwise(entry * (F.lit(1.0) + move))
    return F.when(leverage <= 0, entry).otherwise(price)


def distance_pct(target: Column, mark: Column) -> Column:
    """|target - mark| as a percentage of mark; 0 where mark is not positive."""
    return F.when(mark > 0, F.abs(target - mark) / mark * F.lit(100.0)).otherwise(F.lit(0.0))

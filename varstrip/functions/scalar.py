"""Scalar guards, time arithmetic and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.params import PUBLISH_INTERVAL_SECONDS, SECONDS_PER_YEAR

# A decimal number as the venues write it; rejects blanks, padding, inf and nan.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RFC3339_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that is computed once per row, however often it is read.

    A plain column is copied into every expression and pushed-down filter that names it; the
    output of a generator, here of one row each, is not.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def is_finite(x: Column) -> Column:
    """True only for ordinary numbers. Spark treats NaN as equal to itself and above all else."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    return F.when(is_finite(x), x)


def clean_decimal(text: Column) -> Column:
    """Venue decimal text to double; blank, unparsable or non-finite gives NULL."""
    return finite_or_null(F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double")))


def clean_long(text: Column) -> Column:
    """Whole-number text to bigint, NULL on anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def non_negative_part(x: Column) -> Column:
    """max(x, 0) where a NaN counts as 0."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def year_fraction(now: Column, expiry: Column) -> Column:
    """Years of exactly 365 days; negative once expired."""
    return seconds_between(expiry, now) / F.lit(float(SECONDS_PER_YEAR))


def years_to_minutes(years: Column) -> Column:
    return years * F.lit(365.0 * 1440.0)


def minutes_to_years(minutes: Column) -> Column:
    return minutes / F.lit(365.0 * 1440.0)


def two_sided_mid(bid: Column, ask: Column) -> Column:
    """Midpoint, only where both sides are quoted."""
    return F.when(bid.isNotNull() & ask.isNotNull(), (ask + bid) * F.lit(0.5))


def log_moneyness(strike: Column, forward: Column) -> Column:
    return F.ln(strike / forward)


def to_millis(ts: Column) -> Column:
    """Truncate a timestamp to whole milliseconds."""
    return F.timestamp_millis(F.unix_millis(ts))


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket holding ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * F.lit(seconds))


def bucket_end(ts: Column, seconds: int) -> Column:
    """First bucket boundary at or after ``ts``."""
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * F.lit(seconds))


def rfc3339(ts: Column) -> Column:
    """UTC text with milliseconds, e.g. 2026-05-25T13:28:12.978Z."""
    return F.date_format(ts, RFC3339_MILLIS)


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of RFC 3339 text; NULL where malformed."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(shape, text.try_cast("timestamp"))


def hash_hex(digest: Column) -> Column:
    """Wire form of a digest: lowercase hex."""
    return F.lower(F.hex(digest))


def hash_display(text: Column) -> Column:
    """0x-prefix a 32-byte hex digest; leave anything else as it is."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.concat(F.lit("0x"), text)).otherwise(text)


def next_update_eta(age_seconds: Column, interval: int = PUBLISH_INTERVAL_SECONDS) -> Column:
    """Seconds to the next publish, within [0, interval]. Ages truncate toward zero."""
    whole = F.when(age_seconds < 0, F.ceil(age_seconds)).otherwise(F.floor(age_seconds))
    return F.greatest(F.lit(0), F.least(F.lit(interval), F.lit(interval) - whole)).cast("bigint")


# One more than the largest sequence number that a packed order can hold.
SEQUENCES = 10**19


def packed_order(when: Column, sequence: Column | None = None) -> Column:
    """Order by time, then sequence, as one fixed-width number.

    Latest-value aggregates ordered by a number are hash aggregates; ordered by a struct they sort
    all rows first. ``when`` is a whole number (microseconds or seconds). Any non-negative bigint
    fits as ``sequence``, so no tie rule is lost.
    """
    if sequence is None:
        return when.cast("bigint")
    return when.cast("decimal(19,0)") * F.lit(str(SEQUENCES)).cast("decimal(20,0)") + sequence.cast("decimal(19,0)")

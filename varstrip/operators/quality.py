"""Tick quality: first-failure classification, deduplication, constraint splits, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.scalar import is_finite, non_negative_part, packed_order, seconds_between
from varstrip.params import ASSETS, KINDS, MAX_FITTED_IV, MIN_FITTED_IV, MIN_STRIP_QUOTES, VENUES, QualityConfig

# Identity of one quote update.
DEDUP_KEY = ["venue", "asset", "expiry", "strike", "kind", "received_at"]


def _number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def is_stale(now: Column, received_at: Column, max_age: float) -> Column:
    """Older than ``max_age`` seconds, or dated in the future."""
    return ~seconds_between(now, received_at).between(0.0, max_age)


def is_crossed(bid: Column, ask: Column) -> Column:
    """Both sides quoted, and the book is crossed, locked or negative."""
    return _number(bid) & _number(ask) & ((ask <= bid) | (bid < 0) | (ask < 0))


def is_wide(bid: Column, ask: Column, mid: Column, max_ratio: float) -> Column:
    ratio = (ask - bid) / F.when(mid > 0, mid)
    return _number(bid) & _number(ask) & _number(mid) & _number(ratio) & (ratio > max_ratio)


def is_below_intrinsic(mid: Column, kind: Column, underlying: Column, strike: Column, tolerance: float) -> Column:
    gap = F.when(kind == "call", underlying - strike).otherwise(strike - underlying)
    return _number(mid) & (mid + F.lit(tolerance) < non_negative_part(gap))


def drop_reason(config: QualityConfig = QualityConfig(), now: str = "arrival_ts") -> Column:
    """First failing rule in order stale, crossed, wide_spread, below_intrinsic; else 'pass'.

    A rule whose inputs are missing does not fire.
    """
    c = F.col
    return (
        F.when(is_stale(c(now), c("received_at"), config.max_age_secs), F.lit("stale"))
        .when(F.coalesce(is_crossed(c("bid"), c("ask")), F.lit(False)), F.lit("crossed"))
        .when(
            F.coalesce(is_wide(c("bid"), c("ask"), c("mid"), config.max_spread_ratio), F.lit(False)),
            F.lit("wide_spread"),
        )
        .when(
            F.coalesce(
                is_below_intrinsic(c("mid"), c("kind"), c("underlying"), c("strike"), config.intrinsic_tolerance),
                F.lit(False),
            ),
            F.lit("below_intrinsic"),
        )
        .otherwise(F.lit("pass"))
    )


def classify(ticks: DataFrame, config: QualityConfig = QualityConfig(), now: str = "arrival_ts") -> DataFrame:
    return ticks.withColumn("drop_reason", drop_reason(config, now))


def passing(ticks: DataFrame, config: QualityConfig = QualityConfig(), now: str = "arrival_ts") -> DataFrame:
    return ticks.filter(drop_reason(config, now) == "pass")


def deduplicate(ticks: DataFrame, arrival: str = "arrival_ts") -> DataFrame:
    """Keep the first arrival of every quote update.

    Filtered ticks are at most a few seconds old and the key holds ``received_at``, so a
    sliding window and a global distinct agree. The minimum is taken map-side first, so a
    key with very many copies never travels whole.
    """
    rest = [c for c in ticks.columns if c not in DEDUP_KEY]
    by = packed_order(F.unix_micros(arrival), F.col("seq") if "seq" in rest else None)
    first = ticks.groupBy(*DEDUP_KEY).agg(*[F.min_by(c, by).alias(c) for c in rest])
    return first.select(*ticks.columns)


def duplicate_counts(ticks: DataFrame) -> DataFrame:
    """Copies removed by deduplication, per venue."""
    per_key = ticks.groupBy(*DEDUP_KEY).agg((F.count(F.lit(1)) - 1).alias("extra"))
    return per_key.groupBy("venue").agg(F.sum("extra").alias("deduped"))


def valid_chain_row() -> Column:
    """Known venue, asset and kind (case matters) and a usable strike."""
    return (
        F.col("venue").isin(*VENUES)
        & F.col("asset").isin(*ASSETS)
        & F.col("kind").isin(*KINDS)
        & is_finite(F.col("strike"))
        & (F.col("strike") > 0)
    )


def received_counts(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("venue", "asset").agg(F.count(F.lit(1)).alias("received"))


def filtered_counts(ticks: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    return classify(ticks, config).groupBy("drop_reason").agg(F.count(F.lit(1)).alias("ticks"))


def quality_counters(ticks: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """All tick counters in long form (counter, label, n)."""
    received = received_counts(ticks).select(
        F.lit("received").alias("counter"), F.concat_ws("/", "venue", "asset").alias("label"), F.col("received").alias("n")
    )
    filtered = filtered_counts(ticks, config).filter("drop_reason <> 'pass'").select(
        F.lit("filtered").alias("counter"), F.col("drop_reason").alias("label"), F.col("ticks").alias("n")
    )
    deduped = duplicate_counts(passing(ticks, config)).select(
        F.lit("deduped").alias("counter"), F.col("venue").alias("label"), F.col("deduped").alias("n")
    )
    return received.unionByName(filtered).unionByName(deduped)


def index_violation() -> Column:
    """Why a published index row breaks its domain; NULL if it does not."""
    value, confidence = F.col("value"), F.col("confidence")
    digest = F.col("strip_hash_hex")
    return (
        F.when(~is_finite(value) | (value < 0), F.lit("value"))
        .when(~is_finite(confidence) | ~confidence.between(0.0, 1.0), F.lit("confidence"))
        .when(~F.coalesce(digest.rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), F.lit("strip_hash"))
    )


def strip_violation(quotes: str = "quotes") -> Column:
    """Why a strip (array of strike, q, iv) breaks its domain; NULL if it does not."""
    q = F.col(quotes)

    def bad(test):
        return F.exists(q, test)

    return (
        F.when(F.size(q) < MIN_STRIP_QUOTES, F.lit("too_few_quotes"))
        .when(bad(lambda x: ~is_finite(x["strike"]) | (x["strike"] <= 0)), F.lit("strike"))
        .when(bad(lambda x: ~is_finite(x["q"]) | (x["q"] < 0)), F.lit("q"))
        .when(bad(lambda x: ~is_finite(x["iv"]) | ~x["iv"].between(MIN_FITTED_IV, MAX_FITTED_IV)), F.lit("iv"))
    )


def split_on(df: DataFrame, violation: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``reason``)."""
    marked = df.withColumn("reason", violation)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())

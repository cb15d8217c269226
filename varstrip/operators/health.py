"""Freshness and end-to-end checks as small result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.scalar import seconds_between
from varstrip.params import HEALTH_MAX_AGE_SECONDS


def freshness_report(ticks: DataFrame, now: Column, max_age: float = HEALTH_MAX_AGE_SECONDS) -> DataFrame:
    """Age of the newest row and 'ok' or 'degraded'; an empty table reports age -1."""
    newest = ticks.agg(F.max("ts").alias("newest"), F.count(F.lit(1)).alias("rows"))
    age = F.when(F.col("newest").isNotNull(), seconds_between(now, F.col("newest"))).otherwise(F.lit(-1.0))
    df = newest.withColumn("age_s", age)
    bad = F.col("newest").isNull() | (F.col("age_s") == 0) | (F.col("age_s") > max_age)
    df = df.withColumn("status", F.when(bad, "degraded").otherwise("ok"))
    # An age of exactly zero is how an absent row used to look; it reports like one.
    return df.select("rows", F.when(F.col("age_s") == 0, F.lit(-1.0)).otherwise(F.col("age_s")).alias("age_s"), "status")


def pipeline_checks(option_ticks: DataFrame, index_ticks: DataFrame, now: Column, indices: list[str]) -> DataFrame:
    """One row per check (name, observed, passed) over the option and index tables at ``now``.

    Each table is read once; the counts of one pass become the check rows.
    """

    def within(seconds: int) -> Column:
        return (F.col("ts") <= now) & (F.unix_micros("ts") > F.unix_micros(now) - seconds * 1_000_000)

    upto = index_ticks.filter(F.col("ts") <= now)
    options = option_ticks.agg(F.count_if(within(60)).cast("double").alias("v")).select(
        F.inline(F.array(F.struct(F.lit("option_ticks_last_minute").alias("check"), F.col("v").alias("observed"))))
    )
    stats = upto.agg(
        F.count_if(within(120)).cast("double").alias("recent"),
        F.countDistinct("ts").cast("double").alias("distinct_ts"),
        F.max_by("value", "ts").alias("latest"),
        F.countDistinct(F.date_trunc("minute", "ts")).cast("double").alias("bars"),
        *[F.count_if(within(75) & (F.col("index_id") == i)).cast("double").alias(f"live_{i}") for i in indices],
    )
    rows = [
        ("index_ticks_last_two_minutes", "recent"),
        ("index_distinct_times", "distinct_ts"),
        ("index_latest_value", "latest"),
        ("history_bars", "bars"),
        *[(f"live_ticks_{i}", f"live_{i}") for i in indices],
    ]
    index_rows = stats.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("check"), F.col(col).alias("observed")) for n, col in rows]))
    )
    limit = F.when(F.col("check") == "index_distinct_times", F.lit(2.0)).otherwise(F.lit(1.0))
    passed = F.when(F.col("check") == "index_latest_value", F.col("observed") > 0).otherwise(F.col("observed") >= limit)
    return options.unionByName(index_rows).withColumn("passed", F.coalesce(passed, F.lit(False)))

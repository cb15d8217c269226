"""Cross-tick outlier policy: a venue that stays away from the median is left out.

The policy reads like a state machine but needs no sequential fold. Streaks depend only on
in-band resets. A drop takes effect at a tick where the venue's streak has reached the
limit *and* some venue stays in; otherwise every drop of that tick is rolled back. So a
venue is dropped exactly if such a tick lies between its last in-band tick and now, which
is a comparison of two running maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varstrip.functions.scalar import bucket_start, is_finite
from varstrip.operators.index import median_of
from varstrip.operators.ordered import carried, dealt, last_rows, running
from varstrip.params import OutlierConfig

TICK = ["index_id", "snapshot_ts"]
VENUE = ["index_id", "venue"]
# Smallest magnitude at which a median still counts as non-zero (double epsilon).
EPSILON = 2.220446049250313e-16


def deviations(values: DataFrame, config: OutlierConfig = OutlierConfig()) -> DataFrame:
    """Add the raw median of the tick, the relative deviation and whether it is out of band.

    A tick with fewer than two venues or a degenerate median is not evaluable.
    """
    tick = Window.partitionBy(*TICK)
    df = values.withColumn("_values", F.collect_list("value").over(tick))
    df = df.withColumns({"venues": F.size("_values"), "median": median_of(F.col("_values"))}).drop("_values")
    evaluable = (F.col("venues") >= 2) & is_finite(F.col("median")) & (F.abs("median") >= EPSILON)
    deviation = F.when(evaluable, F.abs((F.col("value") - F.col("median")) / F.col("median")))
    df = df.withColumns({"evaluable": evaluable, "deviation": deviation})
    out = F.when(F.isnan("deviation"), F.lit(False)).otherwise(F.col("deviation") > config.threshold)
    return df.withColumn("out_of_band", F.coalesce(out, F.lit(False)))


def streaks(values: DataFrame, config: OutlierConfig = OutlierConfig(), bucket_seconds: int = 86_400) -> DataFrame:
    """Add ``streak``: consecutive out-of-band ticks so far, untouched by non-evaluable ticks.

    ``_seen`` numbers the evaluable ticks of a venue, ``_reset`` is the number of its last
    in-band tick, so their difference is the streak. Both come from one pass over day buckets.
    """
    df = deviations(values, config)
    rows, parts, day = dealt(df, VENUE, ["snapshot_ts"], bucket_start(F.col("snapshot_ts"), bucket_seconds))
    here = day.rowsBetween(Window.unboundedPreceding, 0)
    in_band = F.col("_row.evaluable") & ~F.col("_row.out_of_band")
    rows = rows.withColumn("_total", F.sum(F.col("_row.evaluable").cast("long")).over(here))
    rows = rows.withColumn("_last", F.max(F.when(in_band, F.col("_total"))).over(here))
    earlier = Window.partitionBy(*VENUE).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    days = last_rows(rows, parts).withColumn("_base", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    days = days.withColumn("_base_reset", F.max(F.col("_base") + F.col("_last")).over(earlier))
    rows = carried(rows, days.select(*parts, "_base", "_base_reset"), parts)
    seen = F.col("_base") + F.col("_total")
    reset = F.coalesce(F.col("_base") + F.col("_last"), F.col("_base_reset"), F.lit(0))
    own = [F.col(f"_row.{c}").alias(c) for c in df.columns]
    return rows.select(*own, F.col("_bucket").alias("_day"), seen.alias("_seen"), reset.alias("_reset"), (seen - reset).alias("streak"))


def evaluate(values: DataFrame, config: OutlierConfig = OutlierConfig(), bucket_seconds: int = 86_400) -> DataFrame:
    """Mark every venue row as active or not, with the transitions of its tick.

    ``values`` holds index_id, snapshot_ts, venue, value and whatever should be carried. It
    has one row per venue and snapshot, tiny next to the quotes behind it. It is computed once:
    whatever reads rows twice below reads one exchange twice.
    """
    df = streaks(values, config, bucket_seconds)
    at_limit = F.col("out_of_band") & (F.col("streak") >= config.streak)
    df = df.withColumn("_at_limit", at_limit)
    df = df.withColumn("_someone_stays", F.max(~F.col("_at_limit")).over(Window.partitionBy(*TICK)))
    takes_effect = F.col("_at_limit") & F.col("_someone_stays")
    in_band = F.col("evaluable") & ~F.col("out_of_band")
    df = running(
        df,
        VENUE,
        ["snapshot_ts"],
        F.col("_day"),
        {"_drop": ("max", F.when(takes_effect, F.col("_seen"))), "_r": ("max", F.when(in_band, F.col("_seen")))},
        {"_drop_before": "_drop", "_reset_before": "_r"},
    )
    # _seen orders the last drop against the last reset; an in-band tick is a reset itself.
    df = df.withColumn("dropped", F.coalesce(F.col("_drop") > F.col("_reset"), F.lit(False)))
    was = F.coalesce(F.col("_drop_before") > F.coalesce("_reset_before", F.lit(0)), F.lit(False))
    df = df.withColumns(
        {
            "newly_dropped": F.col("dropped") & ~was,
            "newly_restored": ~F.col("dropped") & was,
            # Rolled back: at its limit, not dropped before, and nobody else stays in.
            "_returned": F.col("_at_limit") & ~F.col("_someone_stays") & ~was,
        }
    )
    stays = (
        F.when(F.col("venues") < 2, F.lit(True))
        .when(~F.col("evaluable"), ~F.col("dropped"))
        .otherwise(~F.col("_at_limit") | F.col("_returned"))
    )
    df = df.withColumn("_stays", stays)
    # Publishing something always wins: with nobody left, every present venue is used.
    anyone = F.max("_stays").over(Window.partitionBy(*TICK))
    return df.withColumn("active", F.col("_stays") | ~anyone).drop(
        "_seen", "_reset", "_at_limit", "_someone_stays", "_drop", "_drop_before", "_r", "_reset_before", "_returned", "_stays", "_day"
    )


def transitions(evaluated: DataFrame) -> DataFrame:
    """Drop and restore events with the figures an operator wants to see."""
    moved = evaluated.filter(F.col("newly_dropped") | F.col("newly_restored"))
    return moved.select(
        *TICK,
        "venue",
        F.when(F.col("newly_dropped"), "dropped").otherwise("restored").alias("transition"),
        "value",
        "median",
        "deviation",
        "streak",
    )


def counters(evaluated: DataFrame) -> DataFrame:
    """What an operator watches, in long form (index_id, counter, label, n): drops and restorations of
    each venue so far, and the active venues at the newest tick."""
    moves = [F.struct(F.lit(f"outlier_{k}").alias("counter"), F.col("venue").alias("label"), F.count_if(f"newly_{k}").alias("n")) for k in ("dropped", "restored")]
    drops = evaluated.groupBy("index_id", "venue").agg(F.array(*moves).alias("_c")).select("index_id", F.inline("_c")).filter("n > 0")
    live = evaluated.groupBy(*TICK).agg(F.count_if("active").alias("n"))
    gauge = live.groupBy("index_id").agg(F.max_by("n", "snapshot_ts").alias("n"))
    return drops.unionByName(gauge.select("index_id", F.lit("active_venues").alias("counter"), F.lit("newest").alias("label"), "n"))

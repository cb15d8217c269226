"""Per-venue 30-day index, cross-venue blend, confidence and audit hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varstrip.functions.scalar import is_finite, seconds_between, years_to_minutes
from varstrip.operators.chain import pick_expiries
from varstrip.operators.strip import strip_quotes, strip_variance
from varstrip.params import FRESH_BUDGET_SECONDS, INDEX_DIMENSION, MINUTES_30D, MINUTES_365D, SNAPSHOT_SECONDS, TARGET_STRIKES, VENUES_EXPECTED

VENUE_KEY = ["snapshot_ts", "venue", "asset"]
CHAIN_FIELDS = ["expiry", "t", "forward", "listed_strikes", "knots"]


def interpolate_30d(near_minutes: Column, near_sigma: Column, next_minutes: Column, next_sigma: Column) -> Column:
    """30-day variance from two expiries, linear in total variance."""
    span = next_minutes - near_minutes
    w_near = (next_minutes - F.lit(MINUTES_30D)) / span
    w_next = (F.lit(MINUTES_30D) - near_minutes) / span
    total = near_minutes / F.lit(MINUTES_365D) * near_sigma * w_near + next_minutes / F.lit(MINUTES_365D) * next_sigma * w_next
    return total * F.lit(MINUTES_365D / MINUTES_30D)


def interpolation_status(near_minutes: Column, near_sigma: Column, next_minutes: Column, next_sigma: Column, total: Column) -> Column:
    def bad(x: Column, test: Column) -> Column:
        return ~is_finite(x) | test

    return (
        F.when(bad(near_minutes, near_minutes <= 0), F.lit("near_minutes"))
        .when(bad(next_minutes, next_minutes <= 0), F.lit("next_minutes"))
        .when(near_minutes >= next_minutes, F.lit("inverted_bracket"))
        .when(bad(near_sigma, near_sigma < 0), F.lit("near_variance"))
        .when(bad(next_sigma, next_sigma < 0), F.lit("next_variance"))
        .when(~is_finite(total), F.lit("non_finite"))
        .when(total < 0, F.lit("negative"))
        .otherwise(F.lit("ok"))
    )


def index_points(sigma_sq_30d: Column) -> Column:
    """100 * sqrt(variance); NULL where the variance is negative or not finite."""
    return F.when(is_finite(sigma_sq_30d) & (sigma_sq_30d >= 0), F.lit(100.0) * F.sqrt(sigma_sq_30d))


def _both_sides(picked: DataFrame) -> DataFrame:
    """One row per (snapshot, venue, asset, side) with the chosen chain's columns."""
    sides = F.array(
        *[F.struct(F.lit(s).alias("side"), *[F.col(f"{s}.{c}").alias(c) for c in CHAIN_FIELDS]) for s in ("near", "next")]
    )
    return picked.select(*VENUE_KEY, "latest_ts", "bracket_status", F.inline(sides))


def venue_index(chains: DataFrame, near_rule: str = "max") -> DataFrame:
    """Index of every (snapshot, venue, asset) that has any chain, with a ``status`` label.

    The chosen near and next chains are computed as two rows and folded back on the same
    keys, so nothing is shuffled beyond the placement the chains already have.
    """
    sides = _both_sides(pick_expiries(chains, near_rule, CHAIN_FIELDS))
    var = strip_variance(sides, [*VENUE_KEY, "side"], carry=["latest_ts", "bracket_status"])

    def side(name: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(column))).alias(f"{name}_{column}")

    wide = var.groupBy(*VENUE_KEY).agg(
        F.max("latest_ts").alias("latest_ts"),
        F.max("bracket_status").alias("bracket_status"),
        *[
            side(s, column)
            for s in ("near", "next")
            for column in ("t", "forward", "k_zero", "listed_strikes", "strip_status", "variance_status", "sigma_sq")
        ],
    )
    near_min, next_min = years_to_minutes(F.col("near_t")), years_to_minutes(F.col("next_t"))
    total = interpolate_30d(near_min, F.col("near_sigma_sq"), next_min, F.col("next_sigma_sq"))
    wide = wide.withColumn("sigma_sq_30d", total)
    joint = interpolation_status(near_min, F.col("near_sigma_sq"), next_min, F.col("next_sigma_sq"), F.col("sigma_sq_30d"))
    value = index_points(F.col("sigma_sq_30d"))
    status = (
        F.when(F.col("bracket_status") != "ok", F.col("bracket_status"))
        .when(F.col("near_strip_status") != "ok", F.lit("near_strip"))
        .when(F.col("next_strip_status") != "ok", F.lit("next_strip"))
        .when(F.col("near_variance_status") != "ok", F.lit("near_variance"))
        .when(F.col("next_variance_status") != "ok", F.lit("next_variance"))
        .when(joint != "ok", F.lit("interp"))
        .when(value.isNull(), F.lit("index_value"))
        .otherwise(F.lit("ok"))
    )
    wide = wide.withColumn("status", status)
    return wide.withColumn("value", F.when(F.col("status") == "ok", value))


def with_venue_freshness(venues: DataFrame) -> DataFrame:
    """Replace ``latest_ts`` by the newest quote of the venue over all of its assets.

    A window over the few assets of one venue and snapshot: one pass, where a join would
    compute the venue rows twice.
    """
    return venues.withColumn("latest_ts", F.max("latest_ts").over(Window.partitionBy("snapshot_ts", "venue")))


def for_indices(venues: DataFrame, dimension: DataFrame) -> DataFrame:
    """Attach the index ids of each asset. The optimizer broadcasts the dimension if it is small."""
    return venues.join(dimension, "asset")


def confidence_score(
    venues_live: Column,
    max_age_seconds: Column,
    strip_strikes: Column,
    venues_expected: int = VENUES_EXPECTED,
    target_strikes: int = TARGET_STRIKES,
) -> Column:
    """Product of venue coverage, freshness and strike coverage, each within [0, 1]."""

    def unit(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    coverage = unit(venues_live / F.lit(float(venues_expected))) if venues_expected else F.lit(1.0)
    fresh = unit(F.lit(1.0) - F.greatest(max_age_seconds, F.lit(0.0)) / F.lit(FRESH_BUDGET_SECONDS))
    strikes = unit(strip_strikes / F.lit(float(target_strikes))) if target_strikes else F.lit(1.0)
    raw = coverage * fresh * strikes
    return F.when(is_finite(raw), unit(raw)).otherwise(F.lit(0.0))


def median_of(values: Column) -> Column:
    """Median of an array column: middle, or midpoint of the middle two; NaN sorts last."""
    ordered = F.array_sort(values)
    n = F.size(values)
    upper = F.get(ordered, F.floor(n / 2).cast("int"))
    lower = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, F.when(n % 2 == 1, upper).otherwise((lower + upper) * F.lit(0.5)))


def blend(active: DataFrame, venues_expected: int = VENUES_EXPECTED, target_strikes: int = TARGET_STRIKES) -> DataFrame:
    """Blended index per (index, snapshot) from its active venue rows.

    The median runs over the venues of one snapshot, a handful of values.
    """
    age = seconds_between(F.col("snapshot_ts"), F.col("latest_ts"))
    grouped = active.groupBy("index_id", "snapshot_ts").agg(
        median_of(F.collect_list("value")).alias("value"),
        F.count(F.lit(1)).alias("venues_live"),
        F.max(age).alias("max_age"),
        F.min(F.least("near_listed_strikes", "next_listed_strikes")).alias("strip_strikes"),
        F.min("venue").alias("primary_venue"),
    )
    score = confidence_score(F.col("venues_live"), F.col("max_age"), F.col("strip_strikes"), venues_expected, target_strikes)
    return grouped.withColumn("confidence", score)


@F.pandas_udf(T.BinaryType())
def _little_endian(values: pd.Series) -> pd.Series:
    """Doubles of each array as little-endian bytes; Spark SQL has no such conversion."""
    return values.map(lambda a: np.asarray(a, dtype="<f8").tobytes())


def strip_bytes(strips: DataFrame) -> DataFrame:
    """Byte form of each strip: forward, K0, T, then (strike, q, iv) per point."""
    triples = F.flatten(F.transform("quotes", lambda q: F.array(q["strike"], q["q"], q["iv"])))
    numbers = F.concat(F.array("forward", "k_zero", "t"), triples)
    return strips.withColumn("bytes", _little_endian(numbers))


def venue_strips(chains: DataFrame, near_rule: str = "max") -> DataFrame:
    """Full near and next strips per (snapshot, venue, asset, side)."""
    sides = _both_sides(pick_expiries(chains, near_rule, CHAIN_FIELDS))
    return strip_quotes(sides, [*VENUE_KEY, "side"])


def strip_hash(strips: DataFrame, active: DataFrame, dimension: DataFrame) -> DataFrame:
    """SHA-256 per (index, snapshot) over the strips of the active venues.

    Venues in alphabetical order, each as label, a zero byte, near strip, next strip.
    """
    raw = strip_bytes(strips).select(*VENUE_KEY, "side", "bytes")
    per_venue = raw.groupBy(*VENUE_KEY).agg(
        F.max(F.when(F.col("side") == "near", F.col("bytes"))).alias("near"),
        F.max(F.when(F.col("side") == "next", F.col("bytes"))).alias("next"),
    )
    tagged = for_indices(per_venue, dimension).join(
        active.select("index_id", "snapshot_ts", "venue"), ["index_id", "snapshot_ts", "venue"], "left_semi"
    )
    part = F.concat(F.encode(F.col("venue"), "UTF-8"), F.unhex(F.lit("00")), F.col("near"), F.col("next"))
    grouped = tagged.groupBy("index_id", "snapshot_ts").agg(
        F.array_sort(F.collect_list(F.struct("venue", part.alias("part")))).alias("parts")
    )
    whole = F.aggregate("parts", F.unhex(F.lit("")), lambda acc, p: F.concat(acc, p["part"]))
    return grouped.select("index_id", "snapshot_ts", F.sha2(whole, 256).alias("strip_hash_hex"))


def publish_rows(snapshots: DataFrame, results: DataFrame) -> DataFrame:
    """One row per expected (index, snapshot): the value, or NULL with the reason.

    ``snapshots`` lists (index_id, snapshot_ts, silent, had_chains) and ``results`` the blended rows.
    """
    joined = snapshots.join(results, ["index_id", "snapshot_ts"], "left")
    status = (
        F.when(F.col("value").isNotNull(), F.lit("ok"))
        .when(F.col("silent"), F.lit("no_quotes"))
        .when(F.col("had_chains"), F.lit("no_venues_live"))
        .otherwise(F.lit("missing_asset"))
    )
    return joined.withColumn("status", status).drop("silent", "had_chains")


def snapshot_slots(snapshots: DataFrame, cadence: int, bucket_seconds: int = 86_400) -> DataFrame:
    """Every ``snapshot_ts`` of the cadence from the first to the last one seen, seen or not.

    One row with the ends is cut into time buckets, and the slots are made where those lie.
    """
    at = F.unix_seconds("snapshot_ts")
    ends = snapshots.agg(F.min(at).alias("_low"), F.max(at).alias("_high")).filter("_low IS NOT NULL")
    width = -(-bucket_seconds // cadence) * cadence
    step = lambda n: F.lit(n).cast("bigint")
    pieces = ends.withColumn("_from", F.explode(F.sequence("_low", "_high", step(width)))).repartition("_from")
    slots = F.sequence(F.col("_from"), F.least(F.col("_high"), F.col("_from") + width - cadence), step(cadence))
    return pieces.select(F.explode(slots).alias("_at")).select(F.timestamp_seconds("_at").alias("snapshot_ts"))


def snapshot_grid(legs: DataFrame, indices=INDEX_DIMENSION, cadence: int = SNAPSHOT_SECONDS) -> DataFrame:
    """Every (index id, asset) pair at every slot, with whether anything was quoted, and its asset."""
    seen = legs.groupBy("snapshot_ts").agg(F.collect_set("asset").alias("assets"))
    ids = F.array(*[F.struct(F.lit(i).alias("index_id"), F.lit(a).alias("asset")) for i, a in indices])
    slots = snapshot_slots(seen, cadence).join(seen, "snapshot_ts", "left")
    return slots.select("snapshot_ts", "assets", F.inline(ids)).select(
        "index_id", "snapshot_ts", F.col("assets").isNull().alias("silent"), F.coalesce(F.array_contains("assets", F.col("asset")), F.lit(False)).alias("had_chains")
    )

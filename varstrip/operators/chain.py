"""From clean ticks to option chains per (snapshot, venue, asset, expiry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.scalar import bucket_end, finite_or_null, is_finite, packed_order, year_fraction
from varstrip.operators.quality import valid_chain_row
from varstrip.params import (
    BRACKET_YEARS,
    MIN_QUOTED_USD,
    NEAR_MIN_YEARS,
    SNAPSHOT_LOOKBACK_SECONDS,
    SNAPSHOT_SECONDS,
    STRICT_MIN_IV,
)

INSTRUMENT = ["venue", "asset", "expiry", "strike", "kind"]
CHAIN = ["snapshot_ts", "venue", "asset", "expiry"]


def assign_snapshots(
    ticks: DataFrame,
    cadence: int = SNAPSHOT_SECONDS,
    lookback: int = SNAPSHOT_LOOKBACK_SECONDS,
    ts: str = "ts",
) -> DataFrame:
    """Give every tick the snapshots that may use it: ``snapshot - lookback <= ts <= snapshot``.

    With ``lookback <= cadence`` a tick feeds at most one snapshot and nothing is copied.
    Otherwise it is exploded into the few snapshots of its own look-back; there is never
    a range join.
    """
    first = bucket_end(F.col(ts), cadence)
    if lookback <= cadence:
        return ticks.withColumn("snapshot_ts", first).filter(
            F.unix_micros("snapshot_ts") - F.unix_micros(ts) <= lookback * 1_000_000
        )
    last = F.timestamp_seconds(
        F.floor((F.unix_micros(ts) + lookback * 1_000_000) / (cadence * 1_000_000)) * cadence
    )
    step = F.expr(f"INTERVAL {int(cadence)} SECONDS")
    return ticks.withColumn("snapshot_ts", F.explode(F.sequence(first, last, step)))


def _latest(column: str, when: str = "TRUE") -> Column:
    """Latest non-null value: NULLs never win, and equal times fall back to ``seq``.

    Rows that do not count get no order, which is how the aggregate skips them.
    """
    counts = F.expr(f"{column} IS NOT NULL AND {when}")
    return F.max_by(column, F.when(counts, packed_order(F.unix_micros("ts"), F.col("seq"))))


def latest_quotes(ticks: DataFrame) -> DataFrame:
    """One row per snapshot and instrument, each column at its latest non-null value.

    Needs ``snapshot_ts``, ``ts`` and a ``seq`` tie-break. Aggregates map-side before the
    shuffle, so an instrument that ticks very often is reduced where it is read.
    """
    values = ["bid", "ask", "mid", "iv", "underlying"]
    return ticks.groupBy("snapshot_ts", *INSTRUMENT).agg(
        *[_latest(v).alias(v) for v in values], F.max("ts").alias("latest_ts")
    )


def fold_legs(quotes: DataFrame) -> DataFrame:
    """Call and put rows of a strike side by side; non-finite mids and IVs become NULL."""

    def side(kind: str, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, finite_or_null(F.col(column)))).alias(f"{kind}_{column}")

    return quotes.filter(valid_chain_row()).groupBy(*CHAIN, "strike").agg(
        side("call", "mid"), side("put", "mid"), side("call", "iv"), side("put", "iv"),
        F.max("latest_ts").alias("latest_ts"),
    )


def latest_legs(ticks: DataFrame) -> DataFrame:
    """``fold_legs(latest_quotes(ticks))`` in a single shuffle."""
    return ticks.filter(valid_chain_row()).groupBy(*CHAIN, "strike").agg(
        *[
            finite_or_null(_latest(column, f"kind = '{kind}'")).alias(f"{kind}_{column}")
            for column in ("mid", "iv")
            for kind in ("call", "put")
        ],
        F.max("ts").alias("latest_ts"),
    )


def usable_iv() -> Column:
    """Call IV if finite, else put IV if finite; each side is checked before they combine."""
    return F.coalesce(finite_or_null(F.col("call_iv")), finite_or_null(F.col("put_iv")))


def is_two_sided() -> Column:
    """Both mids finite and above the smallest quotable price."""
    c, p = F.col("call_mid"), F.col("put_mid")
    return is_finite(c) & is_finite(p) & (c > MIN_QUOTED_USD) & (p > MIN_QUOTED_USD)


def strict_legs(legs: DataFrame) -> DataFrame:
    """Stricter variant: both legs present and an IV above 0.001."""
    both = F.col("call_mid").isNotNull() & F.col("put_mid").isNotNull()
    return legs.filter(both & (usable_iv() > STRICT_MIN_IV))


def assemble_chains(legs: DataFrame, rate: float = 0.0) -> DataFrame:
    """One row per chain: forward by put-call parity, IV knots sorted by strike, counts.

    The legs of a chain are the listed strikes of one expiry, a few hundred at the most, and
    land in one array. All chains of a (snapshot, venue, asset) are placed together, so the
    expiry choice and the per-venue index need no further shuffle.
    """
    strike_ok = is_finite(F.col("strike")) & (F.col("strike") > 0)
    prepared = legs.repartition("snapshot_ts", "venue", "asset").withColumns(
        {
            "_iv": F.when(strike_ok, usable_iv()),
            "_two_sided": strike_ok & is_two_sided(),
            "_gap": F.abs(F.col("call_mid") - F.col("put_mid")),
        }
    )
    chains = prepared.groupBy(*CHAIN).agg(
        F.expr(
            "min_by(struct(strike, call_mid, put_mid), struct(_gap, strike)) FILTER (WHERE _two_sided)"
        ).alias("parity"),
        F.array_sort(F.expr("collect_list(struct(strike AS k, _iv AS iv)) FILTER (WHERE _iv IS NOT NULL)")).alias("knots"),
        F.max("latest_ts").alias("latest_ts"),
    )
    years = year_fraction(F.col("snapshot_ts"), F.col("expiry"))
    growth = F.exp(F.lit(float(rate)) * F.col("t"))
    forward = F.col("parity.strike") + growth * (F.col("parity.call_mid") - F.col("parity.put_mid"))
    return chains.withColumn("t", years).select(
        *CHAIN,
        "t",
        forward.alias("forward"),
        F.col("parity.strike").alias("parity_strike"),
        F.size("knots").alias("listed_strikes"),
        "knots",
        "latest_ts",
    )


def pick_expiries(chains: DataFrame, near_rule: str = "max", carry: list[str] | None = None) -> DataFrame:
    """Near (7 to 30 days) and next (beyond 30 days) expiry per (snapshot, venue, asset).

    ``near_rule`` takes the latest ("max") or earliest ("min") near expiry. An expiry at
    exactly 30 days is neither. ``bracket_status`` names what is missing.
    """
    if near_rule not in ("max", "min"):
        raise ValueError(f"near_rule must be 'max' or 'min', got {near_rule!r}")
    carry = carry or [c for c in chains.columns if c not in CHAIN[:3]]
    marked = chains.withColumns(
        {
            "_near": (F.col("t") >= NEAR_MIN_YEARS) & (F.col("t") < BRACKET_YEARS),
            "_next": F.col("t") > BRACKET_YEARS,
            "_chain": F.struct(*carry),
        }
    )
    picked = marked.groupBy("snapshot_ts", "venue", "asset").agg(
        F.expr(f"{near_rule}_by(_chain, t) FILTER (WHERE _near)").alias("near"),
        F.expr("min_by(_chain, t) FILTER (WHERE _next)").alias("next"),
        *([F.max("latest_ts").alias("latest_ts")] if "latest_ts" in chains.columns else []),
    )
    has_near, has_next = F.col("near").isNotNull(), F.col("next").isNotNull()
    status = (
        F.when(has_near & has_next, F.lit("ok"))
        .when(has_near, F.lit("no_next_expiry"))
        .when(has_next, F.lit("no_near_expiry"))
        .otherwise(F.lit("no_bracket"))
    )
    return picked.withColumn("bracket_status", status)


def venue_freshness(quotes: DataFrame) -> DataFrame:
    """Newest quote per (snapshot, venue) over all of the venue's assets."""
    return quotes.groupBy("snapshot_ts", "venue").agg(F.max("latest_ts").alias("latest_ts"))

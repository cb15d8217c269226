"""Variance from the listed strikes themselves (no fitted curve)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varstrip.functions.scalar import year_fraction
from varstrip.operators.index import index_points, interpolate_30d
from varstrip.operators.strip import variance_from_integral
from varstrip.params import MIN_QUOTED_USD, MIN_STRIP_QUOTES

CHAIN = ["snapshot_ts", "venue", "asset", "expiry"]
QUOTES = ("mid", "mark", "bid", "ask")


def quote_price(rows: DataFrame, quote: str = "mid") -> Column:
    """Coin price under a quote rule; 'mid' falls back to mark when a side is not positive."""
    bid, ask, mark = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("bid_price", "ask_price", "mark_price")]
    rules = {
        "mid": F.when((bid > 0) & (ask > 0), F.lit(0.5) * (bid + ask)).otherwise(mark),
        "mark": mark,
        "bid": bid,
        "ask": ask,
    }
    if quote not in rules:
        raise ValueError(f"unknown quote {quote!r}; known are {QUOTES}")
    return rules[quote]


def top_of_hour(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Only rows stamped exactly on the hour."""
    return rows.filter(F.col(ts) == F.date_trunc("hour", ts))


def with_spot(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One spot per snapshot: the ``underlying_price`` of its first row by ``order`` for all of them."""
    snapshot = Window.partitionBy(*keys)
    return rows.withColumn("underlying_price", F.min_by("underlying_price", F.struct(*order)).over(snapshot))


def pivot_sides(rows: DataFrame, price: Column, keys: list[str], order: str, both: bool = True) -> DataFrame:
    """Call and put price and IV side by side per strike, last value by ``order``.

    ``both`` keeps only strikes priced on either side; the IV falls back from call to put.
    """
    df = rows.withColumns({"_p": price, "_iv": F.coalesce(F.col("mark_iv"), F.lit(0.0)) / F.lit(100.0)})

    def last(kind: str, column: str, name: str) -> Column:
        return F.expr(f"max_by({column}, {order}) FILTER (WHERE type = '{kind}' AND {column} IS NOT NULL)").alias(name)

    wide = df.groupBy(*keys, F.col("strike_price").alias("strike")).agg(
        last("call", "_p", "call"), last("put", "_p", "put"), last("call", "_iv", "call_iv"), last("put", "_iv", "put_iv"),
        F.max("underlying_price").alias("underlying"),
    )
    wide = wide.withColumn("iv", F.coalesce("call_iv", "put_iv"))
    return wide.filter(F.col("call").isNotNull() & F.col("put").isNotNull()) if both else wide


def with_forward(legs: DataFrame, keys: list[str], priced_only: bool = True) -> DataFrame:
    """Add T, the parity forward, K0 (largest listed strike at or below it) and the leg count.

    Legs of one expiry are the listed strikes, so the windows stay small. Chains that are too
    thin or expired drop out, and with ``priced_only`` those without a forward and K0.
    """
    chain = Window.partitionBy(*keys)
    two_sided = (F.col("call") > MIN_QUOTED_USD) & (F.col("put") > MIN_QUOTED_USD)
    gap = F.struct(F.abs(F.col("call") - F.col("put")), F.col("strike"))
    best = F.min(F.when(two_sided, F.struct(gap.alias("gap"), "call", "put", "strike"))).over(chain)
    df = legs.withColumns({"t": year_fraction(F.col("snapshot_ts"), F.col("expiry")), "_best": best, "_n": F.count(F.lit(1)).over(chain)})
    df = df.filter((F.col("_n") >= MIN_STRIP_QUOTES) & (F.col("t") > 0))
    df = df.withColumn("forward", F.col("_best.strike") + (F.col("_best.call") - F.col("_best.put")))
    k_zero = F.max(F.when(F.col("strike") <= F.col("forward"), F.col("strike"))).over(chain)
    df = df.withColumn("k_zero", k_zero).drop("_best", "_n")
    return df.filter(F.col("k_zero").isNotNull()) if priced_only else df


def otm_strip(legs: DataFrame, keys: list[str], intrinsic_filter: bool | Column = True, tolerance: float = 1e-9) -> DataFrame:
    """Out-of-the-money strip after wing termination: rows (keys, strike, q).

    Walking out from K0 on either side, zero quotes are skipped and the wing ends at the
    first two zeros in a row. A quote below intrinsic value counts as zero. A chain without a
    K0 keeps its rows, on no side and without a price.
    """
    k, f = F.col("strike"), F.col("forward")
    put, call = F.col("put"), F.col("call")
    unfiltered = F.lit(not intrinsic_filter) if isinstance(intrinsic_filter, bool) else ~intrinsic_filter
    put = F.when(unfiltered | (put + tolerance >= F.greatest(k - f, F.lit(0.0))), put).otherwise(F.lit(0.0))
    call = F.when(unfiltered | (call + tolerance >= F.greatest(f - k, F.lit(0.0))), call).otherwise(F.lit(0.0))
    k_zero = F.col("k_zero")
    side = F.when(k_zero.isNull(), "none").when(k < k_zero, "put").when(k > k_zero, "call").otherwise("center")
    df = legs.withColumns({"_put": put, "_call": call, "side": side})
    price = (
        F.when(F.col("side") == "put", F.col("_put"))
        .when(F.col("side") == "call", F.col("_call"))
        .when(F.col("side") == "center", F.lit(0.5) * (F.col("_put") + F.col("_call")))
    )
    distance = F.abs(k - F.col("k_zero"))
    df = df.withColumns({"q": price, "_distance": distance, "_zero": (price <= 0).cast("int")})
    outward = Window.partitionBy(*keys, "side").orderBy("_distance")
    df = df.withColumn("_pair", (F.col("_zero") == 1) & (F.coalesce(F.lag("_zero").over(outward), F.lit(0)) == 1))
    ended = F.max(F.col("_pair").cast("int")).over(outward.rowsBetween(Window.unboundedPreceding, 0))
    kept = df.withColumn("_ended", ended).filter(
        F.col("side").isin("center", "none") | ((F.col("_ended") == 0) & (F.col("_zero") == 0))
    )
    return kept.drop("_put", "_call", "_distance", "_zero", "_pair", "_ended")


def strike_intervals(strip: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``delta_k``: half the gap between neighbours, one-sided at the ends.

    A strip of a single strike has no interval, hence NULL.
    """
    w = Window.partitionBy(*keys).orderBy("strike")
    before, after = F.lag("strike").over(w), F.lead("strike").over(w)
    k = F.col("strike")
    delta = (
        F.when(before.isNotNull() & after.isNotNull(), F.lit(0.5) * (after - before))
        .when(after.isNotNull(), after - k)
        .when(before.isNotNull(), k - before)
    )
    return strip.withColumn("delta_k", delta)


def listed_chains(legs: DataFrame, keys: list[str], intrinsic_filter: bool | Column = True) -> DataFrame:
    """Every chain that qualifies for the expiry choice, with its variance where it has one.

    ``sigma_sq`` is NULL without a forward or with a single kept strike, and may come out
    negative. All windows and the aggregation run on one placement by ``keys``.
    """
    strip = otm_strip(with_forward(legs, keys, priced_only=False), keys, intrinsic_filter)
    k = F.col("strike")
    total = strike_intervals(strip, keys).groupBy(*keys).agg(
        F.sum(F.col("delta_k") / (k * k) * F.col("q")).alias("integral"),
        F.count("q").alias("strikes"),
        *[F.max(c).alias(c) for c in ("t", "forward", "k_zero")],
    )
    return total.withColumn(
        "sigma_sq", variance_from_integral(F.col("integral"), F.col("t"), F.col("forward"), F.col("k_zero"))
    )


def listed_variance(legs: DataFrame, keys: list[str], intrinsic_filter: bool | Column = True) -> DataFrame:
    """Variance of the chains that have one."""
    return listed_chains(legs, keys, intrinsic_filter).filter(F.col("sigma_sq").isNotNull())


def index_from_picked(picked: DataFrame) -> DataFrame:
    """30-day index of (snapshot, asset) rows holding near and next structs."""
    minutes = {s: F.col(f"{s}.t") * F.lit(365.0 * 1440.0) for s in ("near", "next")}
    total = interpolate_30d(minutes["near"], F.col("near.sigma_sq"), minutes["next"], F.col("next.sigma_sq"))
    df = picked.withColumn("_total", total)
    negative = (F.col("near.sigma_sq") < 0) | (F.col("next.sigma_sq") < 0)
    status = (
        F.when(F.col("bracket_status") != "ok", F.lit("no_expiry_pair"))
        .when(F.col("near.sigma_sq").isNull() | F.col("next.sigma_sq").isNull(), F.lit("compute_err:thin_strip"))
        .when(negative, F.lit("compute_err:negative_variance"))
        .when(index_points(F.col("_total")).isNull(), F.lit("compute_err:interpolation"))
        .otherwise(F.lit("ok"))
    )
    df = df.withColumn("status", status)
    return df.withColumn("index_value", F.when(F.col("status") == "ok", index_points(F.col("_total")))).drop("_total")

"""Historical backtests of the index against a benchmark."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.pricing import with_option_prices
from varstrip.operators import benchmark as bm
from varstrip.operators import chain, index, listed
from varstrip.params import BRACKET_YEARS, NEAR_MIN_YEARS, STRICT_MIN_IV


@dataclass(frozen=True)
class Variant:
    """One setting of the knobs; ``label`` names it."""

    quote: str = "mid"
    near_rule: str = "max"
    intrinsic_filter: bool = True
    benchmark_field: str = "close"

    @property
    def price_key(self) -> str:
        return f"{self.quote}/{'on' if self.intrinsic_filter else 'off'}"

    @property
    def label(self) -> str:
        return f"{self.price_key}/{self.near_rule}/{self.benchmark_field}"


# Every combination of quote, near rule, intrinsic filter and benchmark field.
VARIANTS = tuple(Variant(*knobs) for knobs in product(listed.QUOTES, ("max", "min"), (True, False), ("close", "open")))
SNAPSHOT = ["snapshot_ts", "venue", "asset"]

PICK = ["expiry", "t", "sigma_sq"]


def snapshot_rows(history: DataFrame, venue: str = "deribit") -> DataFrame:
    """Top-of-hour rows under the column names of the chain operators, at one spot per snapshot.

    ``venue`` names the history that has no such column.
    """
    rows = listed.top_of_hour(history).select(
        F.col("timestamp").alias("snapshot_ts"),
        F.col("venue") if "venue" in history.columns else F.lit(venue).alias("venue"),
        F.col("currency").alias("asset"),
        F.col("expiration").alias("expiry"),
        "symbol",
        "type",
        "strike_price",
        "bid_price",
        "ask_price",
        "mark_price",
        "mark_iv",
        "underlying_price",
        "arrival_seq",
    )
    return listed.with_spot(rows, SNAPSHOT, ["arrival_seq", "symbol"])


def usd(rows: DataFrame, quote: str) -> Column:
    return listed.quote_price(rows, quote) * F.col("underlying_price")


def listed_legs(rows: DataFrame, quote: str = "mid") -> DataFrame:
    return listed.pivot_sides(rows, usd(rows, quote), listed.CHAIN, "arrival_seq")


def listed_backtest(rows: DataFrame, candles: DataFrame) -> DataFrame:
    """Index per (snapshot, venue, asset) from listed strikes, with the nearest benchmark and a status."""
    chains = listed.listed_chains(listed_legs(rows), listed.CHAIN)
    picked = chain.pick_expiries(chains, "max", PICK)
    # A snapshot whose chains are all too thin still reports, as having no expiry pair.
    seen = rows.select(*SNAPSHOT).distinct()
    results = listed.index_from_picked(seen.join(picked, SNAPSHOT, "left").fillna({"bracket_status": "no_bracket"}))
    return bm.join_nearest(results.select(*SNAPSHOT, "index_value", "status"), candles)


def fitted_chains(rows: DataFrame, quote: str = "mid") -> DataFrame:
    """Chains for the fitted curve: strikes priced on both sides, IV knots above 0.001."""
    legs = listed_legs(rows, quote)
    usable = F.when(F.col("iv") > STRICT_MIN_IV, F.col("iv"))
    return chain.assemble_chains(
        legs.select(
            *listed.CHAIN, "strike", F.col("call").alias("call_mid"), F.col("put").alias("put_mid"),
            usable.alias("call_iv"), F.lit(None).cast("double").alias("put_iv"), F.col("snapshot_ts").alias("latest_ts"),
        )
    )


def fitted_backtest(rows: DataFrame, candles: DataFrame, near_rule: str = "max", quote: str = "mid", field: str = "close") -> DataFrame:
    """Index from the fitted curve with the benchmark at the same hour."""
    venues = index.venue_index(fitted_chains(rows, quote), near_rule)
    good = venues.filter(F.col("status") == "ok")
    return bm.join_exact(good.select(*SNAPSHOT, F.col("value").alias("index_value")), candles, field)


def priced_variants(rows: DataFrame, variants=VARIANTS) -> DataFrame:
    """Both sides of every strike under each distinct price rule: chain keys, price_key, intrinsic, strike, call, put.

    The last row of a side is found once, with its price under every quote; rows are only
    multiplied when there is one per strike.
    """
    quotes = sorted({v.quote for v in variants})
    own = F.struct(*[usd(rows, q).alias(q) for q in quotes])
    sides = rows.withColumn("_own", own).groupBy(*listed.CHAIN, F.col("strike_price").alias("strike")).agg(
        *[F.expr(f"max_by(_own, arrival_seq) FILTER (WHERE type = '{side}')").alias(f"_{side}") for side in ("call", "put")]
    )
    both = sides.filter("_call IS NOT NULL AND _put IS NOT NULL")
    rules = {v.price_key: v for v in variants}
    rule = lambda key, v: F.struct(
        F.lit(key).alias("price_key"), F.lit(v.intrinsic_filter).alias("intrinsic"), F.col(f"_call.{v.quote}").alias("call"), F.col(f"_put.{v.quote}").alias("put")
    )
    return both.select(*listed.CHAIN, "strike", F.inline(F.array(*[rule(k, v) for k, v in rules.items()])))


def variant_errors(rows: DataFrame, candles: DataFrame, variants=VARIANTS) -> DataFrame:
    """Relative error of every variant at every (snapshot, venue, asset), from a single pass over the history.

    Variants that share quote and filter share their chain variances; both near rules come
    out of one aggregation; the label is attached only to the small picked rows.
    """
    keys = ["price_key", *listed.CHAIN, "intrinsic"]
    chains = listed.listed_chains(priced_variants(rows, variants), keys, F.col("intrinsic"))
    near = (F.col("t") >= NEAR_MIN_YEARS) & (F.col("t") < BRACKET_YEARS)
    marked = chains.withColumns({"_c": F.struct(*PICK), "_near": near, "_next": F.col("t") > BRACKET_YEARS})
    picked = marked.groupBy("price_key", *SNAPSHOT).agg(
        F.expr("max_by(_c, t) FILTER (WHERE _near)").alias("near_max"),
        F.expr("min_by(_c, t) FILTER (WHERE _near)").alias("near_min"),
        F.expr("min_by(_c, t) FILTER (WHERE _next)").alias("next"),
    )
    labels = F.array(
        *[
            F.struct(
                F.lit(v.label).alias("variant"), F.lit(v.price_key).alias("_key"), F.lit(v.near_rule).alias("near_rule"),
                F.lit(v.benchmark_field).alias("field"),
            )
            for v in variants
        ]
    )
    named = picked.select("*", F.inline(labels)).filter(F.col("_key") == F.col("price_key"))
    named = named.withColumn("near", F.when(F.col("near_rule") == "max", F.col("near_max")).otherwise(F.col("near_min")))
    both = F.col("near").isNotNull() & F.col("next").isNotNull()
    named = named.withColumn("bracket_status", F.when(both, "ok").otherwise("no_bracket"))
    results = listed.index_from_picked(named).filter(F.col("status") == "ok")
    side = candles.select("asset", F.col("timestamp").alias("snapshot_ts"), "open", "close")
    joined = results.join(side, ["asset", "snapshot_ts"])
    joined = joined.withColumn("benchmark", F.when(F.col("field") == "open", F.col("open")).otherwise(F.col("close")))
    return bm.relative_errors(joined.select("variant", *SNAPSHOT, "index_value", "benchmark"))


def fitted_errors(rows: DataFrame, candles: DataFrame) -> DataFrame:
    """The same for the fitted curve, against both fields of the benchmark."""
    fitted = index.venue_index(fitted_chains(rows)).filter(F.col("status") == "ok").select(*SNAPSHOT, F.col("value").alias("index_value"))
    fields = F.array(*[F.struct(F.lit(f"fitted/max/{f}").alias("variant"), F.col(f).alias("benchmark")) for f in ("close", "open")])
    side = candles.select("asset", F.col("timestamp").alias("snapshot_ts"), F.inline(fields))
    return bm.relative_errors(fitted.join(side, ["asset", "snapshot_ts"]).select("variant", *SNAPSHOT, "index_value", "benchmark"))


def variant_sweep(rows: DataFrame, candles: DataFrame, variants=VARIANTS) -> DataFrame:
    """One summary row per variant and asset, of listed strikes and of the fitted curve."""
    return bm.error_summary(variant_errors(rows, candles, variants).unionByName(fitted_errors(rows, candles)), ["variant", "asset"])


def vanilla_ratio(rows: DataFrame, quote: str = "mid") -> DataFrame:
    """Quoted USD price over the Black-76 price at the mark IV, per strike and side.

    Strikes within half to twice the spot.
    """
    legs = listed_legs(rows, quote)
    legs = listed.with_forward(legs, listed.CHAIN)
    k, spot = F.col("strike"), F.col("underlying")
    window = legs.filter((k > F.lit(0.5) * spot) & (k < F.lit(2.0) * spot))
    sides = window.select(
        *listed.CHAIN, "strike", "t", "forward",
        F.inline(
            F.array(
                F.struct(F.lit("call").alias("kind"), F.col("call").alias("quote_usd"), F.col("call_iv").alias("iv")),
                F.struct(F.lit("put").alias("kind"), F.col("put").alias("quote_usd"), F.col("put_iv").alias("iv")),
            )
        ),
    )
    sides = with_option_prices(sides, F.col("forward"), F.col("strike"), F.col("t"), F.col("iv"))
    model = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("put"))
    sides = sides.withColumn("model_usd", model).drop("call", "put")
    return sides.withColumn("ratio", F.col("quote_usd") / F.when(F.col("model_usd") > 0, F.col("model_usd")))

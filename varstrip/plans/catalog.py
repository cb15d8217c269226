"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Computed doubles that pass through exp/ln or through sums whose order may differ are
rounded, so that two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varstrip.functions import fixedpoint as fx
from varstrip.functions import pricing, scalar
from varstrip.functions.instruments import GRAMMARS, decompose
from varstrip.operators import benchmark as bm
from varstrip.operators import chain, health, index, listed, outlier, perp, quality, rollup, shares, strip, thinning
from varstrip.params import INDEX_DIMENSION, OutlierConfig, QualityConfig, ThinningConfig
from varstrip.plans import backtest, frames, index_pipeline, inputs, round_trips
from varstrip.session import prepare
from varstrip.sources import historical, messages, sinks, venues
from varstrip.sources.shared import stored
from varstrip.streaming import index_sink
from varstrip.streaming import rollup as stream_rollup
from varstrip.streaming import ticks as stream_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = ["snapshot_ts", "venue", "asset"]
CHAIN = chain.CHAIN
# A moment inside the data, and a trade-clock one day after the last event.
NOW = "2024-01-30 23:00:00"
CLOCK = 1_706_745_600
INDEX_IDS = [i for i, _ in INDEX_DIMENSION]


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def now_at(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp")


# ---------------------------------------------------------------- sources


def _decoded(df: DataFrame) -> DataFrame:
    """Decoded rows with an absent underlying as NULL, which compares across engines."""
    return df.withColumn("underlying", F.when(~F.isnan("underlying"), F.col("underlying")))


@query
def decode_deribit_frames(spark, sf):
    return _decoded(venues.decode_deribit(frames.deribit_frames(spark, sf)))


@query
def decode_okx_frames(spark, sf):
    return _decoded(venues.decode_okx(frames.okx_frames(spark, sf)))


@query
def decode_bybit_frames(spark, sf):
    return _decoded(venues.decode_bybit(frames.bybit_frames(spark, sf)))


@query
def venue_reject_counts(spark, sf):
    rows = None
    for name, source in (("deribit", frames.deribit_frames), ("okx", frames.okx_frames), ("bybit", frames.bybit_frames)):
        bad = venues.rejected(venues.DECODERS[name](source(spark, sf))).select("venue", "reject_reason")
        rows = bad if rows is None else rows.unionByName(bad)
    return rows.groupBy("venue", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query
def instrument_names(spark, sf):
    rows = frames.instrument_texts(spark, sf)
    part = None
    for venue in GRAMMARS:
        test = F.col("venue") == venue
        value = decompose(F.col("name"), venue)
        part = F.when(test, value) if part is None else part.when(test, value)
    rows = rows.withColumn("p", part)
    good = F.col("p.reason").isNull()
    return rows.select("seq", "venue", *[F.when(good, F.col(f"p.{c}")).alias(c) for c in ("asset", "expiry", "strike", "kind")], "p.reason")


@query
def decimal_clean(spark, sf):
    ev = inputs.events(spark, sf)
    v = F.col("value").cast("string")
    text = (
        F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 7 == 1, "abc").when(F.col("k") % 7 == 2, "inf")
        .when(F.col("k") % 7 == 3, "nan").when(F.col("k") % 7 == 4, F.concat(v, F.lit("e1"))).when(F.col("k") % 7 == 5, F.concat(F.lit(" "), v))
        .otherwise(v)
    )
    return ev.select("event_id", scalar.clean_decimal(text).alias("number"))


@query
def instrument_universe(spark, sf):
    ev = inputs.events(spark, sf)
    names = ev.select(
        inputs.venue_of(F.col("event_id")).alias("venue"),
        F.concat(F.lit("I"), F.when(F.col("user_id") % 5 == 0, "_").otherwise("-"), F.col("user_id").cast("string")).alias("name"),
        "user_id",
        "event_id",
    )
    listing = names.groupBy("venue", "name", "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "venue", "name",
        (F.col("user_id") % 3 != 0).alias("is_active"),
        F.when(F.col("user_id") % 7 == 0, "PreLaunch").otherwise("Trading").alias("status"),
        F.when(F.col("user_id") % 4 == 0, "USDC").otherwise("USDT").alias("quote_coin"),
    )
    return venues.keep_universe(names, venues.tradable_universe(listing)).select("event_id", "venue", "name")


@query
def history_csv_clean(spark, sf):
    return historical.clean_chain_rows(frames.history_text_rows(spark, sf))


@query
def benchmark_candles(spark, sf):
    c = inputs.benchmark(spark, sf)
    twice = c.select(
        "asset", F.unix_millis("timestamp").alias("timestamp_ms"), "open", "high", "low", "close",
        F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"),
    ).withColumn("close", F.col("close") + F.col("seq"))
    return bm.clean_candles(twice, "2024-01-03", "2024-01-20").drop("seq")


@query
def candle_gaps(spark, sf):
    return bm.candle_gaps(inputs.benchmark(spark, sf))


@query
def tick_retention(spark, sf):
    return sinks.retained(inputs.raw_ticks(spark, sf), F.lit("2025-01-15").cast("date")).groupBy("venue", "asset").agg(
        F.count(F.lit(1)).alias("kept"), F.min("ts").alias("oldest")
    )


@query
def tick_messages(spark, sf):
    msg = messages.tick_messages(inputs.raw_ticks(spark, sf))
    p = F.from_json("payload", "expiry string, received_at string, ts string, kind string, bid double, mid double")
    return msg.select("seq", "topic", p["expiry"].alias("expiry"), p["received_at"].alias("received_at"), p["ts"].alias("ts"),
                      p["kind"].alias("kind"), p["bid"].alias("bid"), p["mid"].alias("mid"), F.col("payload").contains('"bid":null').alias("bid_null"))


@query
def index_messages(spark, sf):
    ticks = inputs.index_ticks(spark, sf)
    stream = messages.index_stream_messages(ticks).groupBy(F.col("topic").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    latest = messages.index_latest_rows(ticks, ["ts", "seq"])
    newest = latest.select("key", F.get_json_object("payload", "$.ts").alias("ts"), F.get_json_object("payload", "$.strip_hash").alias("strip_hash"))
    return stream.select("key", "n", F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("strip_hash")).unionByName(
        newest.select("key", F.lit(1).cast("bigint").alias("n"), "ts", "strip_hash")
    )


@query
def client_ticks(spark, sf):
    msgs = messages.index_stream_messages(inputs.index_ticks(spark, sf))
    bad = F.col("seq") % 50
    msgs = msgs.select(
        "seq",
        F.when(bad == 7, "index:OTHER:stream").when(bad == 8, "options:okx:btc").otherwise(F.col("topic")).alias("topic"),
        F.when(bad == 9, "{broken").when(bad == 10, F.regexp_replace("payload", '"ts":"[^"]*"', '"ts":"yesterday"'))
        .otherwise(F.col("payload")).alias("payload"),
    )
    return messages.client_ticks(msgs, INDEX_IDS, now_at())


@query
def strip_envelopes(spark, sf):
    """Newest strips of each index's primary venue as the published envelope."""
    legs = inputs.chain_legs(spark, sf)
    chains = chain.assemble_chains(legs)
    dim = inputs.index_dimension(spark)
    evaluated = index_pipeline.evaluated_venues(index.with_venue_freshness(index.venue_index(chains)), dim)
    newest = F.max("snapshot_ts").over(Window.partitionBy("index_id", "asset"))
    last = evaluated.filter("active").withColumn("_newest", newest).filter("snapshot_ts = _newest")
    primary = last.groupBy("index_id", "asset", "snapshot_ts").agg(F.min("venue").alias("venue"))
    wanted = chains.join(primary.select("snapshot_ts", "venue", "asset"), KEY, "left_semi")
    sides = index.venue_strips(wanted)
    one = F.struct("forward", "k_zero", "t", "quotes")
    wide = sides.groupBy(*KEY).agg(
        F.max_by(one, F.when(F.col("side") == "near", 1)).alias("near"), F.max_by(one, F.when(F.col("side") == "next", 1)).alias("next")
    )
    rows = wide.join(primary, KEY).select("index_id", F.col("snapshot_ts").alias("ts"), "near", "next")
    return messages.strip_envelopes(rows)


@query
def index_domain_split(spark, sf):
    ticks = inputs.index_ticks(spark, sf)
    k = F.col("seq") % 11
    odd = ticks.withColumns(
        {
            "value": F.when(k == 1, F.lit(float("nan"))).when(k == 2, -F.col("value") - 1).otherwise(F.col("value")),
            "confidence": F.when(k == 3, F.lit(1.5)).otherwise(F.col("confidence")),
            "strip_hash_hex": F.when(k == 4, F.lit("zz")).otherwise(F.col("strip_hash_hex")),
        }
    )
    good, bad = quality.split_on(odd, quality.index_violation())
    return good.select("seq", F.lit("valid").alias("reason")).unionByName(bad.select("seq", "reason"))


@query
def strip_domain_split(spark, sf):
    legs = inputs.chain_legs(spark, sf)
    iv = F.when(F.col("strike") == 40, F.coalesce("call_iv", F.lit(9.0)) * F.lit(6.0)).otherwise(F.col("put_iv"))
    strips = legs.filter(F.col("put_mid").isNotNull()).groupBy(*CHAIN).agg(
        F.collect_list(F.struct("strike", F.least("call_mid", "put_mid").alias("q"), iv.alias("iv"))).alias("quotes")
    )
    return strips.withColumn("reason", quality.strip_violation()).select(*CHAIN, "reason")


# ---------------------------------------------------------------- quality


@query
def tick_rule_flags(spark, sf):
    t = inputs.raw_ticks(spark, sf)
    c = F.col

    def yes(x):
        return F.coalesce(x, F.lit(False))

    return t.select(
        "seq", "arrival_ts",
        quality.is_stale(c("arrival_ts"), c("received_at"), 5.0).alias("stale"),
        yes(quality.is_crossed(c("bid"), c("ask"))).alias("crossed"),
        yes(quality.is_wide(c("bid"), c("ask"), c("mid"), 0.30)).alias("wide"),
        yes(quality.is_below_intrinsic(c("mid"), c("kind"), c("underlying"), c("strike"), 0.01)).alias("below"),
    )


@query
def tick_drop_reasons(spark, sf):
    return quality.filtered_counts(inputs.raw_ticks(spark, sf))


@query
def tuned_drop_reasons(spark, sf):
    """The tick filter with thresholds read from settings."""
    config = QualityConfig.from_dict({"max_age_secs": 3, "max_spread_ratio": 0.1, "intrinsic_tolerance": 2.5})
    return quality.filtered_counts(inputs.raw_ticks(spark, sf), config)


@query
def clean_ticks(spark, sf):
    return quality.passing(inputs.raw_ticks(spark, sf)).select("seq", "venue", "asset", "expiry", "strike", "kind", "bid", "ask", "mid", "iv", "received_at", "arrival_ts")


@query
def tick_dedup(spark, sf):
    return quality.deduplicate(inputs.raw_ticks(spark, sf)).select("seq", "venue", "asset", "strike", "kind", "bid", "received_at", "arrival_ts")


@query
def quality_counters(spark, sf):
    return quality.quality_counters(inputs.raw_ticks(spark, sf))


@query
def snapshot_freshness(spark, sf):
    s = chain.assign_snapshots(inputs.raw_ticks(spark, sf))
    return s.groupBy("snapshot_ts", "venue").agg(F.count(F.lit(1)).alias("ticks"), F.max("ts").alias("newest"))


@query
def snapshot_overlap(spark, sf):
    """A look-back longer than the cadence: each tick feeds several snapshots."""
    s = chain.assign_snapshots(inputs.raw_ticks(spark, sf), cadence=3600, lookback=3 * 3600)
    return s.groupBy("snapshot_ts", "venue").agg(F.count(F.lit(1)).alias("ticks"), F.min("ts").alias("oldest"))


def _odd_quotes(spark, sf):
    q = F.col("seq")
    t = inputs.raw_ticks(spark, sf)
    return t.withColumns(
        {
            "venue": F.when(q % 13 == 0, "Deribit").otherwise(F.col("venue")),
            "kind": F.when(q % 17 == 0, "straddle").otherwise(F.col("kind")),
            "strike": F.when(q % 19 == 0, F.lit(float("nan"))).when(q % 23 == 0, -F.col("strike")).otherwise(F.col("strike")),
            "iv": F.when(q % 29 == 0, F.lit(float("inf"))).otherwise(F.col("iv")),
        }
    )


@query
def chain_row_validity(spark, sf):
    t = _odd_quotes(spark, sf).filter(quality.valid_chain_row())
    return t.select("seq", "arrival_ts", "venue", "kind", "strike", scalar.finite_or_null(F.col("mid")).alias("mid"), scalar.finite_or_null(F.col("iv")).alias("iv"))


@query
def finite_guard(spark, sf):
    t = _odd_quotes(spark, sf)
    ok = {c: F.coalesce(scalar.is_finite(F.col(c)), F.lit(False)) for c in ("strike", "iv", "mid")}
    return t.groupBy(*[v.alias(f"{k}_finite") for k, v in ok.items()]).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- chains


def _daily_quotes(spark, sf):
    t = chain.assign_snapshots(_odd_quotes(spark, sf).filter(quality.valid_chain_row()), 86_400, 86_400)
    return t


@query
def latest_quotes(spark, sf):
    return chain.latest_quotes(_daily_quotes(spark, sf)).drop("underlying")


@query
def latest_legs(spark, sf):
    return chain.latest_legs(_daily_quotes(spark, sf))


@query
def venue_freshness(spark, sf):
    return chain.venue_freshness(chain.latest_quotes(_daily_quotes(spark, sf)))


@query
def fold_legs(spark, sf):
    legs = chain.fold_legs(inputs.chain_quotes(spark, sf))
    sides = [f"{k}_{c}" for c in ("mid", "iv") for k in ("call", "put")]
    return legs.groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("legs"), *[F.count(c).alias(f"{c}_n") for c in sides], *[r(F.sum(c)).alias(c) for c in sides]
    )


def _chains(spark, sf):
    return chain.assemble_chains(inputs.chain_legs(spark, sf))


@query
def chain_assembly(spark, sf):
    knots = _chains(spark, sf).select(*CHAIN, F.posexplode("knots").alias("pos", "knot"))
    k, iv = F.col("knot.k"), F.col("knot.iv")
    return knots.groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("knots"), F.min(k).alias("first"), F.max_by(k, "pos").alias("last"),
        F.sum(F.col("pos") * k).alias("weighted"), r(F.sum(iv)).alias("iv_sum"),
    )


@query
def chain_forwards(spark, sf):
    c = _chains(spark, sf)
    return c.select(*CHAIN, "listed_strikes", "parity_strike", r("forward").alias("forward"), r("t", 9).alias("t"), strip.strip_status().alias("strip_status"))


@query
def usable_iv(spark, sf):
    legs = inputs.chain_legs(spark, sf)
    odd = legs.withColumn("call_iv", F.when(F.col("strike") % 12 == 0, F.lit(float("nan"))).otherwise(F.col("call_iv")))
    odd = odd.withColumn("put_iv", F.when(F.col("strike") % 24 == 0, F.lit(float("inf"))).otherwise(F.col("put_iv")))
    return odd.groupBy(*CHAIN).agg(F.count(chain.usable_iv()).alias("usable"), r(F.max(chain.usable_iv())).alias("max_iv"))


@query
def strict_legs(spark, sf):
    return chain.strict_legs(inputs.chain_legs(spark, sf)).groupBy(*CHAIN).agg(F.count(F.lit(1)).alias("legs"))


@query
def minimum_strip(spark, sf):
    c = _chains(spark, sf)
    return c.filter(F.col("listed_strikes") >= 5).groupBy(*KEY).agg(F.count(F.lit(1)).alias("expiries"))


@query
def year_fractions(spark, sf):
    t = inputs.raw_ticks(spark, sf)
    y = scalar.year_fraction(F.col("ts"), F.col("expiry"))
    return t.select("seq", "arrival_ts", y.alias("years"), scalar.years_to_minutes(y).alias("minutes"))


@query
def log_moneyness(spark, sf):
    t = inputs.raw_ticks(spark, sf)
    return t.select("seq", "arrival_ts", r(scalar.log_moneyness(F.col("strike"), F.col("underlying")), 9).alias("x"))


def _picked(spark, sf, rule):
    p = chain.pick_expiries(_chains(spark, sf), rule)
    return p.select(*KEY, "bracket_status", F.col("near.expiry").alias("near_expiry"), F.col("next.expiry").alias("next_expiry"))


@query
def expiry_picker(spark, sf):
    return _picked(spark, sf, "max")


@query
def expiry_picker_earliest(spark, sf):
    return _picked(spark, sf, "min")


# ---------------------------------------------------------------- numerics


@query
def normal_cdf(spark, sf):
    ev = inputs.events(spark, sf)
    x = (F.col("value") - F.lit(50.0)) / F.lit(20.0)
    return ev.select("event_id", r(pricing.norm_cdf(x), 10).alias("cdf"))


@query
def option_prices(spark, sf):
    t = inputs.raw_ticks(spark, sf)
    odd = F.col("seq") % 10
    f = F.when(odd == 1, F.lit(-1.0)).otherwise(F.col("underlying"))
    iv = F.when(odd == 2, F.lit(0.0)).otherwise(F.col("iv"))
    years = F.when(odd == 3, F.lit(0.0)).otherwise(scalar.year_fraction(F.col("ts"), F.col("expiry")))
    p = pricing.with_option_prices(t, f, F.col("strike"), years, iv, 0.05)
    return p.select("seq", "arrival_ts", r("call").alias("call"), r("put").alias("put"))


def _near_next(spark, sf):
    return index._both_sides(chain.pick_expiries(_chains(spark, sf), "max", index.CHAIN_FIELDS))


@query
def spline_curvature(spark, sf):
    """Second derivatives at every knot of the near and next chains."""
    fit = _near_next(spark, sf).filter(strip.strip_status() == "ok")
    xs = F.transform("knots", lambda q: F.ln(q["k"] / F.col("forward")))
    ys = F.transform("knots", lambda q: q["iv"])
    fit = fit.withColumns({"xs": xs, "ys": ys})
    fit = fit.withColumn("ms", strip.second_derivatives(F.col("xs"), F.col("ys")))
    rows = fit.select(*KEY, "side", F.posexplode_outer("ms").alias("pos", "m"))
    m = F.col("m")
    return rows.groupBy(*KEY, "side").agg(
        F.count(F.lit(1)).alias("knots"), r(F.sum(F.abs(m)), 4).alias("total"), r(F.sum(m * F.col("pos")), 3).alias("weighted"),
        r(F.max_by(m, "pos")).alias("last"),
    )


@query
def strip_points(spark, sf):
    """Count, extremes and sums of every priced 801-point strip."""
    pts = strip.grid_points(strip.fit_segments(_near_next(spark, sf)), [*KEY, "side", "strip_status"])
    good = pts.filter(F.col("j").isNotNull())
    return good.groupBy(*KEY, "side").agg(
        F.count(F.lit(1)).alias("points"), F.sum("j").alias("j_sum"),
        r(F.min("strike")).alias("k_min"), r(F.max("strike")).alias("k_max"),
        r(F.sum("q"), 4).alias("q_sum"), r(F.sum("iv"), 4).alias("iv_sum"), r(F.max("q")).alias("q_max"),
        r(F.max(F.when(F.col("j") == F.col("k_zero_index"), F.col("strike")))).alias("k_zero"),
    )


@query
def iv_clamp(spark, sf):
    """Fitted IVs far outside the allowed band are pinned to its ends."""
    chains = _near_next(spark, sf)
    wild = F.transform("knots", lambda q: F.struct(q["k"].alias("k"), ((q["iv"] - F.lit(0.5)) * F.lit(20.0)).alias("iv")))
    pts = strip.grid_points(strip.fit_segments(chains.withColumn("knots", wild)), [*KEY, "side", "strip_status"])
    good = pts.filter(F.col("j").isNotNull())
    return good.groupBy(*KEY, "side").agg(
        F.count_if(F.col("iv") == 1e-4).alias("at_floor"), F.count_if(F.col("iv") == 5.0).alias("at_cap")
    )


@query
def expiry_variance(spark, sf):
    v = strip.strip_variance(_near_next(spark, sf), [*KEY, "side"])
    return v.select(*KEY, "side", "listed_strikes", "strip_status", "variance_status", r("forward").alias("forward"),
                    r("k_zero").alias("k_zero"), r("integral").alias("integral"), r("sigma_sq").alias("sigma_sq"))


@query
def interpolation_cases(spark, sf):
    """Interpolation and index value over a wide range of minutes and variances."""
    ev = inputs.events(spark, sf)
    near = F.col("k") * F.lit(600.0) - F.lit(1200.0)
    nxt = near + (F.col("user_id") % 60) * F.lit(1000.0) - F.lit(2000.0)
    s1, s2 = F.col("value") / F.lit(200.0) - F.lit(0.01), F.col("k") / F.lit(150.0)
    df = ev.select("event_id", near.alias("n1"), nxt.alias("n2"), s1.alias("s1"), s2.alias("s2"))
    c = F.col
    span_ok = c("n1") != c("n2")
    total = F.when(span_ok, index.interpolate_30d(c("n1"), c("s1"), F.when(span_ok, c("n2")), c("s2")))
    df = df.withColumn("total", total)
    status = index.interpolation_status(c("n1"), c("s1"), c("n2"), c("s2"), c("total"))
    ok = status == "ok"
    return df.select("event_id", status.alias("status"), F.when(ok, r("total")).alias("sigma_sq_30d"),
                     F.when(ok, r(index.index_points(c("total")), 4)).alias("value"))


@query
def smile_points(spark, sf):
    """IV smile of the latest near strip per venue and asset."""
    v = index.venue_strips(_chains(spark, sf)).filter(F.col("side") == "near")
    newest = v.groupBy("venue", "asset").agg(F.max_by(F.struct(*[c for c in v.columns if c not in ("venue", "asset")]), "snapshot_ts").alias("s"))
    pts = strip.smile(newest.select("venue", "asset", "s.*"))
    return pts.select("venue", "asset", "snapshot_ts", "pos", r("forward").alias("forward"), r("strike").alias("strike"), r("iv_pct", 5).alias("iv_pct"))


@query
def listed_vs_vanilla(spark, sf):
    v = backtest.vanilla_ratio(backtest.snapshot_rows(inputs.history_chain(spark, sf)))
    return v.groupBy(*CHAIN, "kind").agg(
        F.count(F.lit(1)).alias("strikes"), r(F.sum("quote_usd")).alias("quote_usd"), r(F.sum("model_usd")).alias("model_usd"),
        r(F.max("quote_usd")).alias("quote_max"), r(F.max("model_usd")).alias("model_max"),
    )


# ---------------------------------------------------------------- cross-venue


def _venues(spark, sf):
    return index_pipeline.venue_indices(inputs.chain_legs(spark, sf))


@query
def venue_index(spark, sf):
    v = _venues(spark, sf)
    return v.select(*KEY, "status", r("value").alias("value"), "near_listed_strikes", "next_listed_strikes", "latest_ts")


@query
def venue_rejections(spark, sf):
    v = index.venue_index(_chains(spark, sf))
    return v.groupBy("venue", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def near_next_join(spark, sf):
    """Near and next side by side with the label of what is missing."""
    v = index.venue_index(_chains(spark, sf))
    return v.select(*KEY, "bracket_status", r("near_t", 9).alias("near_t"), r("next_t", 9).alias("next_t"),
                    F.col("near_strip_status"), F.col("next_strip_status"))


def _levels(spark, sf):
    """Venue levels per index and hour, cheap enough to probe the outlier policy alone."""
    base = inputs.chain_base(spark, sf).select("snapshot_ts", "venue", "asset", "latest_ts", (F.lit(100.0) * F.col("iv0")).alias("value"))
    return index.for_indices(base, inputs.index_dimension(spark)).drop("asset")


@query
def index_dimension_join(spark, sf):
    return _levels(spark, sf).groupBy("index_id", "venue").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("highest"))


@query
def deviation_streaks(spark, sf):
    s = outlier.streaks(_levels(spark, sf))
    return s.select("index_id", "snapshot_ts", "venue", "venues", "median", r("deviation", 9).alias("deviation"), "out_of_band", "streak")


@query
def outlier_state(spark, sf):
    e = outlier.evaluate(_levels(spark, sf))
    return e.select("index_id", "snapshot_ts", "venue", "streak", "dropped", "newly_dropped", "newly_restored", "active")


@query
def outlier_transitions(spark, sf):
    t = outlier.transitions(outlier.evaluate(_levels(spark, sf), OutlierConfig(threshold=0.02, streak=3)))
    return rounded(t, "deviation", digits=9)


@query
def outlier_counters(spark, sf):
    """Drop counters and the gauge of active venues, under a policy that drops often."""
    return outlier.counters(outlier.evaluate(_levels(spark, sf), OutlierConfig(threshold=0.02, streak=3)))


@query
def active_and_dropped(spark, sf):
    """Active venues first, dropped ones after, in one table."""
    e = outlier.evaluate(_levels(spark, sf))
    cols = ["index_id", "snapshot_ts", "venue", "value"]
    active = e.filter("active").select(*cols, F.lit(True).alias("active"))
    return active.unionByName(e.filter("NOT active").select(*cols, F.lit(False).alias("active")))


@query
def median_blend(spark, sf):
    e = outlier.evaluate(_levels(spark, sf)).filter("active")
    b = e.groupBy("index_id", "snapshot_ts").agg(index.median_of(F.collect_list("value")).alias("value"), F.count(F.lit(1)).alias("venues_live"), F.min("venue").alias("primary_venue"))
    return b


@query
def confidence_cases(spark, sf):
    ev = inputs.events(spark, sf)
    live, age, strikes = F.col("user_id") % 5, F.col("value") - F.lit(5.0), F.col("k") % 12
    return ev.select("event_id", r(index.confidence_score(live, age, strikes), 9).alias("confidence"),
                     r(index.confidence_score(live, age, strikes, 0, 0), 9).alias("confidence_unset"))


@query
def blended_index(spark, sf):
    b = index_pipeline.blended_index(inputs.chain_legs(spark, sf), inputs.index_dimension(spark))
    return b.select("index_id", "snapshot_ts", r("value").alias("value"), r("confidence").alias("confidence"), "venues_live", "strip_strikes", "primary_venue")


@query
def published_rows(spark, sf):
    p = index_pipeline.published_rows(inputs.chain_legs(spark, sf), inputs.index_dimension(spark), cadence=inputs.HOUR)
    return p.select("index_id", "snapshot_ts", "status", r("value").alias("value"))


@query
def hashed_index(spark, sf):
    h = index_pipeline.hashed_index(inputs.chain_legs(spark, sf), inputs.index_dimension(spark))
    return h.select("index_id", "ts", r("value").alias("value"), r("confidence").alias("confidence"), "strip_hash_hex")


@query
def ticks_to_venue_index(spark, sf):
    """Raw ticks through filter, snapshot, latest quote and chain to per-venue status."""
    legs = index_pipeline.legs_from_ticks(inputs.raw_ticks(spark, sf), 86_400, 86_400)
    return index_pipeline.venue_indices(legs).groupBy("venue", "asset", "status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- series


def _bars(spark, sf):
    return rollup.minute_bars(inputs.index_ticks(spark, sf), ["ts", "seq"])


def _history(spark, sf, interval):
    return rounded(rollup.history(_bars(spark, sf), interval), "avg_confidence", digits=9)


@query
def minute_bars(spark, sf):
    b = _bars(spark, sf)
    return b.select("index_id", "bucket", "open", "high", "low", "close", "count", r(rollup.avg_confidence(), 9).alias("avg_confidence"))


@query
def merged_bars(spark, sf):
    """Bars of two halves of the data merged into the bars of the whole."""
    t = inputs.index_ticks(spark, sf)
    halves = [rollup.minute_bars(t.filter(F.col("seq") % 2 == h), ["ts", "seq"]) for h in (0, 1)]
    b = rollup.merge_bars(halves[0].unionByName(halves[1]))
    return b.select("index_id", "bucket", "open", "high", "low", "close", "count", r(rollup.avg_confidence(), 9).alias("avg_confidence"))


@query
def history_5m(spark, sf):
    return _history(spark, sf, "5m")


@query
def history_1h(spark, sf):
    return _history(spark, sf, "1h")


@query
def history_1d(spark, sf):
    return _history(spark, sf, "1d")


@query
def newest_bars(spark, sf):
    return rollup.latest_bars(rollup.history(_bars(spark, sf), "1h"), 100, INDEX_IDS[0]).drop("avg_confidence")


@query
def timeframe_presets(spark, sf):
    bars = _bars(spark, sf)
    out = None
    for name in rollup.TIMEFRAMES:
        part = rollup.timeframe(bars, name).select(F.lit(name).alias("timeframe"), "index_id", "ts", "open", "close", "count")
        out = part if out is None else out.unionByName(part)
    return out


@query
def latest_value(spark, sf):
    return rollup.latest_value(inputs.index_ticks(spark, sf), ["ts", "seq"])


@query
def latest_view(spark, sf):
    return messages.latest_view(inputs.index_ticks(spark, sf), now_at("2024-01-31 00:00:00"), ["ts", "seq"])


@query
def update_eta(spark, sf):
    t = inputs.raw_ticks(spark, sf)
    age = scalar.seconds_between(F.col("arrival_ts"), F.col("received_at")) * 15 - 5
    return t.select("seq", "arrival_ts", scalar.next_update_eta(age).alias("eta"))


@query
def series_stats(spark, sf):
    return rounded(rollup.series_stats(rollup.history(_bars(spark, sf), "1h")), "change_pct", "avg_confidence")


@query
def bar_moves(spark, sf):
    b = rollup.bar_moves(rollup.history(_bars(spark, sf), "1h"))
    return b.select("index_id", "ts", r("change_pct", 4).alias("change_pct"), "range")


@query
def first_to_last(spark, sf):
    return rounded(rollup.first_to_last(rollup.history(_bars(spark, sf), "1h")), "delta_pct")


@query
def tick_direction(spark, sf):
    t = rollup.tick_direction(inputs.index_ticks(spark, sf), ["ts", "seq"])
    return t.select("index_id", "seq", "value", "previous_value", "direction")


@query
def ema_overlay(spark, sf):
    e = rollup.ema_overlay(rollup.timeframe(_bars(spark, sf), "7d"))
    return e.select("index_id", "ts", "close", "period", r("ema").alias("ema"))


@query
def live_bar(spark, sf):
    t = inputs.index_ticks(spark, sf)
    old = t.filter(F.col("ts") < F.lit("2024-01-30 12:00:00").cast("timestamp"))  # the last bar is half a day old
    bars = rollup.latest_bars(rollup.history(rollup.minute_bars(old, ["ts", "seq"]), "1d"), 30)
    return rollup.patch_live_bar(bars, rollup.latest_value(t, ["ts", "seq"])).drop("avg_confidence")


@query
def freshness_report(spark, sf):
    return health.freshness_report(inputs.index_ticks(spark, sf), now_at("2024-01-31 00:00:00"))


@query
def pipeline_checks(spark, sf):
    return health.pipeline_checks(inputs.raw_ticks(spark, sf), inputs.index_ticks(spark, sf), now_at(), INDEX_IDS)


@query
def index_allow_list(spark, sf):
    ev = inputs.events(spark, sf)
    asked = F.when(F.col("k") % 4 == 0, "btcv30").when(F.col("k") % 4 == 1, "EthV30").when(F.col("k") % 4 == 2, "BTCV30").otherwise("sol")
    return messages.known_index(ev.select("event_id", asked.alias("requested")), inputs.index_dimension(spark))


@query
def fixed_point_quotes(spark, sf):
    t = inputs.index_ticks(spark, sf)
    conf = F.when(F.col("seq") % 9 == 0, F.lit(float("nan"))).when(F.col("seq") % 9 == 1, F.lit(1.7)).otherwise(F.col("confidence"))
    scaled = fx.scale_value(F.col("value") / F.lit(7.0))
    return t.select("seq", scaled.alias("value_scaled"), fx.scale_confidence(conf).alias("confidence_scaled"), fx.unscale_value(scaled).alias("value_back"),
                    fx.deviation_bps(F.col("seq") % 5 * 1000, scaled).alias("bps"))


@query
def rfc3339_round_trip(spark, sf):
    ev = inputs.events(spark, sf)
    text = scalar.rfc3339(F.col("ts"))
    return ev.select("event_id", text.alias("text"), F.unix_millis(scalar.parse_rfc3339(text)).alias("ms"),
                     scalar.hash_display(F.when(F.col("k") % 2 == 0, F.sha2(text, 256)).otherwise(text)).alias("shown"))


# ---------------------------------------------------------------- research


def _rows(spark, sf):
    return backtest.snapshot_rows(inputs.history_chain(spark, sf))


@query
def quote_selector(spark, sf):
    h = inputs.history_chain(spark, sf)
    return h.groupBy("venue", "currency", "timestamp").agg(*[r(F.sum(listed.quote_price(h, q))).alias(q) for q in listed.QUOTES])


@query
def top_of_hour(spark, sf):
    return listed.top_of_hour(inputs.history_chain(spark, sf)).groupBy("venue", "currency", "timestamp").agg(F.count(F.lit(1)).alias("n"))


@query
def pivot_sides(spark, sf):
    legs = backtest.listed_legs(_rows(spark, sf))
    return legs.groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("strikes"), *[r(F.sum(c), 5).alias(c) for c in ("call", "put", "iv")], r(F.max("iv")).alias("iv_max")
    )


@query
def wing_termination(spark, sf):
    legs = _zeroed(backtest.listed_legs(_rows(spark, sf)))
    s = listed.otm_strip(listed.with_forward(legs, listed.CHAIN), listed.CHAIN)
    return s.groupBy(*CHAIN, "side").agg(
        F.count(F.lit(1)).alias("strikes"), F.min("strike").alias("lowest"), F.max("strike").alias("highest"),
        F.sum("strike").alias("strike_sum"), r(F.sum("q"), 5).alias("q"),
    )


def _zeroed(legs: DataFrame) -> DataFrame:
    """Put some zero and some below-intrinsic quotes into the wings."""
    i = ((F.col("strike") - 40) / 4).cast("int") + F.dayofmonth("snapshot_ts")
    call = F.when((F.col("strike") > 120) & (i % 7).isin(2, 3), F.lit(0.0)).when((F.col("strike") > 120) & (i % 11 == 4), F.lit(0.0)).otherwise(F.col("call"))
    put = F.when((F.col("strike") < 80) & (i % 9).isin(5, 6), F.lit(0.0)).when((F.col("strike") < 80) & (i % 5 == 1), F.lit(0.0)).otherwise(F.col("put"))
    return legs.withColumns({"call": call, "put": put})


@query
def strike_intervals(spark, sf):
    legs = _zeroed(backtest.listed_legs(_rows(spark, sf)))
    s = listed.otm_strip(listed.with_forward(legs, listed.CHAIN), listed.CHAIN)
    return listed.strike_intervals(s, listed.CHAIN).filter("delta_k IS NOT NULL").groupBy(*CHAIN).agg(
        F.count(F.lit(1)).alias("strikes"), F.sum("delta_k").alias("width"), F.sum(F.col("delta_k") * F.col("strike")).alias("weighted"),
    )


@query
def listed_variance(spark, sf):
    v = listed.listed_variance(backtest.listed_legs(_rows(spark, sf)), listed.CHAIN)
    return v.select(*CHAIN, "strikes", "k_zero", r("forward").alias("forward"), r("sigma_sq").alias("sigma_sq"))


@query
def resample_last(spark, sf):
    h = inputs.history_chain(spark, sf)
    s = bm.resample_last(h, 3600, 36_000 * 24, ("venue", "currency"))
    return s.groupBy("venue", "currency", "timestamp").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("symbol").alias("symbols"), F.sum("arrival_seq").alias("arrival_sum"),
        r(F.sum("ask_price"), 5).alias("ask_sum"),
    )


def _series(spark, sf):
    lv = _levels(spark, sf)
    return lv.groupBy("index_id", "snapshot_ts").agg(F.max("value").alias("index_value")).join(inputs.index_dimension(spark), "index_id")


@query
def benchmark_exact(spark, sf):
    j = bm.join_exact(_series(spark, sf), inputs.benchmark(spark, sf), "open")
    return j.select("index_id", "snapshot_ts", "index_value", "benchmark")


@query
def benchmark_nearest(spark, sf):
    """Half-hour probes, so that both exact hits and equal distances occur."""
    s = _series(spark, sf)
    probes = s.select("index_id", "asset", "index_value", inputs.seconds_after(F.col("snapshot_ts"), (F.hour("snapshot_ts") % 3) * F.lit(1800)).alias("snapshot_ts"))
    return bm.join_nearest(probes, inputs.benchmark(spark, sf)).select("index_id", "snapshot_ts", "index_value", "benchmark")


def _errors(spark, sf):
    return bm.relative_errors(bm.join_exact(_series(spark, sf), inputs.benchmark(spark, sf)))


@query
def error_summary(spark, sf):
    e = _errors(spark, sf).withColumn("date", F.date_format("snapshot_ts", "yyyy-MM-dd"))
    per_day = bm.error_summary(e, ["asset", "date"])
    overall = bm.error_summary(e).select(F.lit("all").alias("asset"), F.lit(None).cast("string").alias("date"), "n", "bias", "median_abs", "p95_abs", "hit_share")
    return rounded(per_day.unionByName(overall), "bias", "median_abs", "p95_abs", "hit_share")


@query
def benchmark_correlation(spark, sf):
    return rounded(bm.correlation(bm.join_exact(_series(spark, sf), inputs.benchmark(spark, sf)), ["asset"]), "correlation")


@query
def worst_errors(spark, sf):
    w = bm.worst_errors(_errors(spark, sf), 20, ["index_id", "snapshot_ts"])
    return w.select("index_id", "snapshot_ts", r("abs_err").alias("abs_err"))


@query
def listed_backtest(spark, sf):
    b = backtest.listed_backtest(_rows(spark, sf), inputs.benchmark(spark, sf))
    return b.select(*KEY, "status", r("index_value", 5).alias("index_value"), "benchmark")


@query
def status_breakdown(spark, sf):
    b = backtest.listed_backtest(_rows(spark, sf), inputs.benchmark(spark, sf)).withColumn("date", F.date_format("snapshot_ts", "yyyy-MM-dd"))
    return rounded(bm.status_breakdown(b, ["venue", "asset", "date"], ["ok", "no_expiry_pair", "compute_err"]), "success_rate")


@query
def fitted_backtest(spark, sf):
    b = backtest.fitted_backtest(_rows(spark, sf), inputs.benchmark(spark, sf))
    return b.select(*KEY, r("index_value", 5).alias("index_value"), "benchmark")


@query
def variant_sweep(spark, sf):
    return rounded(backtest.variant_sweep(_rows(spark, sf), inputs.benchmark(spark, sf)), "bias", "median_abs", "p95_abs", "hit_share")


@query
def stage_diff(spark, sf):
    """Two runs of the same stages, the second disturbed at known places."""
    v = strip.strip_variance(_near_next(spark, sf), [*KEY, "side"]).filter(F.col("strip_status") == "ok")
    left = v.select(*KEY, "side", "forward", "k_zero", "sigma_sq")
    h = F.hour("snapshot_ts")
    right = left.filter(h != 5).withColumns(
        {
            "sigma_sq": F.when(h % 4 == 1, F.col("sigma_sq") + 1e-3).otherwise(F.col("sigma_sq")),
            "k_zero": F.when(h % 6 == 2, F.col("k_zero") + 0.5).otherwise(F.col("k_zero")),
        }
    )
    d = bm.stage_diff(left, right, [*KEY, "side"], [("forward", 1e-6), ("k_zero", 1e-6), ("sigma_sq", 1e-6)])
    return d.groupBy("venue", "asset", "side", "first_divergence").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- perp book


def _tickets(spark, sf):
    return perp.open_ticket(perp.marks_as_of(inputs.requests(spark, sf), inputs.marks(spark, sf), "opened_at"))


def _triggered(spark, sf):
    return perp.triggered_orders(inputs.orders(spark, sf), inputs.marks(spark, sf))


def _lives(spark, sf):
    fired = _triggered(spark, sf).filter(F.col("position_id").isNotNull())
    fired = fired.select(F.col("position_id").alias("id"), F.col("executed_at").alias("at"), F.lit("order").alias("kind"), F.col("order_id").alias("ref"))
    return perp.lifecycles(_tickets(spark, sf), inputs.attempts(spark, sf).unionByName(fired), inputs.marks(spark, sf))


def _open(spark, sf):
    return perp.open_positions(_lives(spark, sf))


def _latest_marks(spark, sf):
    return perp.latest_marks(inputs.marks(spark, sf))


def _valued(spark, sf, positions):
    return perp.valued(perp.with_marks(positions, _latest_marks(spark, sf)), F.lit(CLOCK))


def longs(df: DataFrame, *columns: str) -> DataFrame:
    """Wide decimals as bigint; every amount here fits."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query
def open_positions(spark, sf):
    return _open(spark, sf).select("id", "trader", "index_id", "is_long", "collateral", "leverage")


@query
def position_marks(spark, sf):
    return perp.with_marks(_open(spark, sf), _latest_marks(spark, sf)).select("id", "index_id", "entry_price", "mark")


@query
def position_values(spark, sf):
    v = _valued(spark, sf, _open(spark, sf))
    return longs(v.select("id", "notional", "pnl", "funding", "equity", "liquidatable", "liquidatable_price_only"), "notional", "pnl", "funding", "equity")


@query
def open_tickets(spark, sf):
    p = perp.marks_as_of(inputs.requests(spark, sf), inputs.marks(spark, sf), "opened_at")
    odd = p.withColumns(
        {
            "leverage": F.when(F.col("id") % 13 == 0, 0).when(F.col("id") % 17 == 0, 11).otherwise(F.col("leverage")).cast("bigint"),
            "collateral": F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("collateral")).cast("bigint"),
        }
    )
    t = perp.open_ticket(odd)
    return longs(t.select("id", "open_fee", "reject_reason", "working_collateral", "open_notional"), "open_fee", "working_collateral", "open_notional")


def _closed(spark, sf):
    return perp.close_settlement(perp.ended(_lives(spark, sf)))


def _liquidated(spark, sf):
    return perp.liquidation_settlement(perp.ended(_lives(spark, sf)))


@query
def position_endings(spark, sf):
    """Life of every position: opened, ended by whom, at which mark."""
    end = lambda c: F.col(f"ending.{c}")
    return _lives(spark, sf).select("id", "entry_price", "collateral", "opened_at", end("kind").alias("kind"), end("ref").alias("ref"), end("at").alias("ended_at"), end("mark").alias("end_mark"))


@query
def close_settlements(spark, sf):
    c = _closed(spark, sf)
    return longs(c.select("id", "kind", "pnl", "equity", "close_fee", "payout", "vault_delta"), "pnl", "equity", "close_fee", "payout", "vault_delta")


@query
def liquidation_settlements(spark, sf):
    c = _liquidated(spark, sf)
    return longs(c.select("id", "equity", "reward", "vault_gain"), "equity", "reward", "vault_gain")


@query
def triggered_orders(spark, sf):
    t = _triggered(spark, sf)
    return t.select("order_id", "kind", "trigger_price", "executed_at", "executed_mark")


@query
def order_executions(spark, sf):
    return perp.executions(_triggered(spark, sf), _lives(spark, sf)).select("order_id", "position_id", "action")


@query
def trader_rows(spark, sf):
    p = _open(spark, sf)
    traders = p.select(F.upper("trader").alias("trader"), "leverage").filter(F.col("leverage") == 10)
    return perp.of_traders(p, traders).select("id", "trader")


@query
def single_trader(spark, sf):
    return perp.of_trader(_open(spark, sf), "0XAB0007").select("id", "trader")


@query
def book_stats(spark, sf):
    s = perp.book_stats(_open(spark, sf))
    return longs(s, "reserved")


def _deltas(spark, sf):
    return perp.vault_deltas(inputs.vault_flows(spark, sf), perp.book_changes(_lives(spark, sf)))


def _ledger(spark, sf):
    """The share ledger and the book's changes behind it; a withdrawal's amount is in shares."""
    flows = inputs.vault_flows(spark, sf).select("seq", "at", "holder", F.col("event_type").alias("kind"), F.col("assets").alias("amount"))
    book = stored(perp.book_changes(_lives(spark, sf)), "book")
    return shares.share_ledger(flows, book), book


@query
def vault_history(spark, sf):
    return longs(perp.vault_history(_deltas(spark, sf)).select("at", "seq", "kind", "delta", "assets"), "delta", "assets")


@query
def vault_totals(spark, sf):
    d = _deltas(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("delta").alias("total"))
    return longs(d, "total")


@query
def vault_report(spark, sf):
    """Vault assets, supply, reserve and the ratios a pool page shows, after every flow and change."""
    ledger, book = _ledger(spark, sf)
    one = longs(shares.vault_totals(ledger, book), "supply", "assets", "reserved")
    return one.withColumns(perp.vault_stats(F.col("assets"), F.col("supply"), F.col("reserved")))


@query
def share_ledger(spark, sf):
    """Every deposit and withdrawal with its verdict, and the vault after it."""
    amounts = ["requested", "shares", "assets", "balance", "supply", "total_assets", "reserved"]
    return longs(shares.with_price(_ledger(spark, sf)[0]).select("seq", "at", "kind", "holder", "status", *amounts, r("share_price", 9).alias("share_price")), *amounts)


@query
def holder_shares(spark, sf):
    return longs(shares.holder_shares(_ledger(spark, sf)[0]), "shares")


@query
def share_conversion(spark, sf):
    f = inputs.vault_flows(spark, sf)
    supply = F.when(F.col("seq") % 6 == 0, 0).otherwise(F.col("assets") + F.lit(1_000_003)).cast("bigint")
    total = F.when(F.col("seq") % 10 == 3, 0).otherwise(F.col("assets") * 2 + F.lit(777)).cast("bigint")
    return f.select("seq", fx.wide(perp.to_shares(F.col("assets"), supply, total)).cast("bigint").alias("shares"),
                    fx.wide(perp.to_assets(F.col("assets"), supply, total)).cast("bigint").alias("redeemed"))


@query
def lp_claims(spark, sf):
    """What all holders could redeem against the vault's assets, after every deposit and withdrawal."""
    ledger, book = _ledger(spark, sf)
    return longs(perp.lp_claims(shares.holder_shares(ledger), shares.vault_totals(ledger, book)), "claims", "assets", "supply")


@query
def fee_report(spark, sf):
    return perp.fee_report(_tickets(spark, sf), _closed(spark, sf))


@query
def reserve_reconciliation(spark, sf):
    lives = _lives(spark, sf)
    return longs(perp.reserve_reconciliation(lives, perp.book_changes(lives)), "reserved", "released", "open_notional")


@query
def liquidation_prices(spark, sf):
    p = perp.with_marks(_open(spark, sf), _latest_marks(spark, sf))
    entry, mark = fx.unscale_value(F.col("entry_price")), fx.unscale_value(F.col("mark"))
    leverage = F.when(F.col("id") % 9 == 0, F.lit(0)).otherwise(F.col("leverage"))
    price = fx.liquidation_price(entry, leverage, F.col("is_long"))
    return p.select("id", r(price).alias("liquidation_price"), r(fx.distance_pct(price, mark)).alias("distance_pct"))


@query
def mark_staleness(spark, sf):
    m = perp.latest_marks(inputs.marks(spark, sf).withColumn("index_id", F.concat("index_id", F.lit("/"), F.floor(F.col("at") / 43_200) % 61)))
    return perp.fresh_marks(m, F.lit(CLOCK - 86_400 + 3600)).select("index_id", "mark", "mark_at", "usable")


@query
def thinned_polls(spark, sf):
    pairs = thinning.poll_pairs(inputs.marks(spark, sf), *INDEX_IDS, 900)
    return thinning.thin(pairs, ThinningConfig(deviation_bps=1500, heartbeat_seconds=7200))


# ---------------------------------------------------------------- streams and sinks, there and back


@query
def streamed_bars(spark, sf):
    """Minute bars of a stream of files, merged from the parts of its batches."""
    folder = round_trips.streamed(inputs.index_ticks(spark, sf), "bars", lambda s, at: stream_rollup.write_bars(s, f"{at}/table", f"{at}/checkpoint"))
    b = stream_rollup.read_bars(spark, f"{folder}/table")
    return b.select("index_id", "bucket", "open", "high", "low", "close", "count", r(rollup.avg_confidence(), 9).alias("avg_confidence"))


@query
def streamed_ticks(spark, sf):
    """Passing ticks of a stream of files, each update once, as the table has them."""
    def fork(source, at):
        return stream_ticks.fork(stream_ticks.clean_stream(source, now="arrival_ts"), f"{at}/table", f"{at}/topic", f"{at}/checkpoint")

    folder = round_trips.streamed(inputs.raw_ticks(spark, sf), "ticks", fork, batches=1)
    return spark.read.parquet(f"{folder}/table").groupBy("venue", "asset", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("strike").alias("strikes"))


@query
def streamed_index(spark, sf):
    """The index table of a stream in which half of the rows come twice, in other batches."""
    t = inputs.index_ticks(spark, sf).drop("seq")
    twice = t.unionByName(t.filter(F.second("ts") % 2 == 0))
    folder = round_trips.streamed(twice, "index", lambda s, at: index_sink.write_index(s, f"{at}/table", f"{at}/checkpoint"))
    return index_sink.read_index(spark, f"{folder}/table").select("index_id", "ts", "value", "confidence")


@query
def tick_table(spark, sf):
    """Ticks of two days read back from the month-partitioned table."""
    t = inputs.raw_ticks(spark, sf)
    path = round_trips.new_folder(t, "tick-table")
    sinks.write_option_ticks(t, path, 4)
    return sinks.read_option_ticks(spark, path, "2024-01-10", "2024-01-12").select("seq", "venue", "asset", "strike", "kind", "ts")

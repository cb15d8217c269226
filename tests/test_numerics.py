"""Strip maths against independent numpy / math.erf implementations and known properties."""

import hashlib
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from varstrip.functions import fixedpoint as fx
from varstrip.functions import pricing, scalar
from varstrip.operators import chain, index, strip

KEYS = ["snapshot_ts", "venue", "asset", "expiry"]


def cdf(x):
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def black(f, k, t, v, call=True):
    d1 = (math.log(f / k) + 0.5 * v * v * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    return f * cdf(d1) - k * cdf(d2) if call else k * cdf(-d2) - f * cdf(-d1)


def test_norm_cdf_matches_erf(spark):
    xs = [float(x) for x in np.linspace(-9, 9, 721)] + [40.0, -40.0, float("inf"), float("-inf")]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pricing.norm_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - cdf(r.x)) for r in got) < 1e-13


def test_norm_cdf_of_nan_is_nan(spark):
    row = spark.range(1).select(pricing.norm_cdf(F.lit(float("nan"))).alias("p")).first()
    assert math.isnan(row.p)


def test_option_prices_and_edges(spark):
    rows = [(100.0, 90.0, 0.2, 0.6), (100.0, 130.0, 0.1, 0.4), (100.0, 80.0, 0.0, 0.5), (100.0, 80.0, 0.3, 0.0), (-1.0, 80.0, 0.3, 0.5), (100.0, 0.0, 0.3, 0.5)]
    df = spark.createDataFrame(rows, "f double, k double, t double, v double")
    got = pricing.with_option_prices(df, *[F.col(c) for c in "fktv"]).collect()
    for r in got[:2]:
        assert r.call == pytest.approx(black(r.f, r.k, r.t, r.v), abs=1e-11)
        assert r.put == pytest.approx(black(r.f, r.k, r.t, r.v, False), abs=1e-11)
    assert [(r.call, r.put) for r in got[2:]] == [(20.0, 0.0), (20.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def flat_legs(spark, sigma=0.5, forward=100.0, days=(14, 60), step=4.0, skew=0.0, venue="deribit"):
    rows = []
    for d in days:
        for i in range(-30, 31):
            k = forward + i * step
            if k > 0:
                v = sigma + skew * math.log(k / forward) ** 2
                rows.append((venue, d, k, black(forward, k, d / 365, v), black(forward, k, d / 365, v, False), v))
    df = spark.createDataFrame(rows, "venue string, d int, strike double, call_mid double, put_mid double, iv double")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return df.select(
        now.alias("snapshot_ts"), "venue", F.lit("btc").alias("asset"), F.timestamp_seconds(F.unix_seconds(now) + F.col("d") * 86400).alias("expiry"),
        "strike", "call_mid", "put_mid", F.col("iv").alias("call_iv"), F.col("iv").alias("put_iv"), now.alias("latest_ts"),
    )


def natural_spline(x, y):
    n = len(x)
    a = np.zeros((n, n))
    b = np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        h0, h1 = x[i] - x[i - 1], x[i + 1] - x[i]
        a[i, i - 1 : i + 2] = h0, 2 * (h0 + h1), h1
        b[i] = 6 * ((y[i + 1] - y[i]) / h1 - (y[i] - y[i - 1]) / h0)
    return np.linalg.solve(a, b)


def reference_variance(ks, ivs, f, t):
    x = np.log(np.array(ks) / f)
    m = natural_spline(x, ivs)
    grid = ks[0] + (ks[-1] - ks[0]) / 800 * np.arange(801)
    grid[-1] = ks[-1]
    gx = np.log(grid / f)
    i = np.clip(np.searchsorted(x, gx, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    a, b = (x[i + 1] - gx) / h, (gx - x[i]) / h
    ivs = np.array(ivs)
    v = np.clip(a * ivs[i] + b * ivs[i + 1] + ((a**3 - a) * m[i] + (b**3 - b) * m[i + 1]) * h * h / 6, 1e-4, 5)
    j0 = np.where(grid <= f)[0][-1]
    q = np.array([black(f, k, t, s, k >= f) for k, s in zip(grid, v)])
    q[j0] = 0.5 * (black(f, grid[j0], t, v[j0]) + black(f, grid[j0], t, v[j0], False))
    integral = np.trapezoid(q / grid**2, grid)
    return 2 / t * integral - (f / grid[j0] - 1) ** 2 / t


def test_variance_matches_dense_solve(spark):
    legs = flat_legs(spark, skew=0.3)
    got = {r.expiry: r for r in strip.strip_variance(chain.assemble_chains(legs), KEYS).collect()}
    rows = legs.collect()
    for expiry, r in got.items():
        mine = sorted((x.strike, x.call_iv) for x in rows if x.expiry == expiry)
        want = reference_variance([k for k, _ in mine], [v for _, v in mine], r.forward, r.t)
        assert r.sigma_sq == pytest.approx(want, abs=1e-10)


def test_every_grid_point_once(spark):
    chains = chain.assemble_chains(flat_legs(spark, step=3.7))
    pts = strip.grid_points(strip.fit_segments(chains), KEYS)
    for r in pts.groupBy("expiry").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("j").alias("d")).collect():
        assert (r.n, r.d) == (801, 801)


@pytest.mark.parametrize("sigma", [0.2, 0.5, 0.9])
def test_flat_iv_gives_its_level(spark, sigma):
    v = index.venue_index(chain.assemble_chains(flat_legs(spark, sigma))).first()
    assert v.status == "ok" and abs(v.value - 100 * sigma) < 5


def test_forward_tie_takes_smallest_strike(spark):
    now = "timestamp'2024-01-01'"
    legs = spark.sql(
        f"SELECT {now} snapshot_ts, 'okx' venue, 'btc' asset, timestamp'2024-01-20' expiry, k strike, 5.0D call_mid, 5.0D put_mid, "
        f"0.5D call_iv, 0.5D put_iv, {now} latest_ts FROM VALUES (110.0D), (90.0D), (100.0D) t(k) WHERE k <> 100"
    )
    assert chain.assemble_chains(legs).first().forward == 90.0


def test_strip_rejections_in_order(spark):
    good = flat_legs(spark, days=(14,))
    cases = {
        "no_two_sided_strike": good.withColumn("put_mid", F.lit(None).cast("double")),
        "too_few_iv": good.filter("strike between 96 and 108"),
        "forward_outside_range": good.withColumn("call_iv", F.when(F.col("strike") > 120, F.col("call_iv"))).withColumn("put_iv", F.lit(None).cast("double")),
        "spline_fit": good.unionByName(good.filter("strike = 96")),
        "non_positive_t": good.withColumn("expiry", F.col("snapshot_ts")),
    }
    for label, legs in cases.items():
        rows = strip.strip_variance(chain.assemble_chains(legs), KEYS).collect()
        assert [r.strip_status for r in rows] == [label]
        assert rows[0].sigma_sq is None


def test_expiry_exactly_thirty_days_is_neither(spark):
    p = chain.pick_expiries(chain.assemble_chains(flat_legs(spark, days=(30,)))).first()
    assert p.bracket_status == "no_bracket"


def test_permuted_input_gives_the_same_rows(spark):
    legs = flat_legs(spark, skew=0.2)
    a = index.venue_index(chain.assemble_chains(legs)).first()
    b = index.venue_index(chain.assemble_chains(legs.orderBy(F.rand(7)).repartition(5, "strike"))).first()
    assert a == b


def test_strip_hash_matches_plain_bytes(spark):
    chains = chain.assemble_chains(flat_legs(spark).unionByName(flat_legs(spark, 0.6, venue="bybit")))
    strips = index.venue_strips(chains)
    dim = spark.createDataFrame([("X", "btc")], "index_id string, asset string")
    active = strips.select(F.lit("X").alias("index_id"), "snapshot_ts", "venue").distinct()
    got = index.strip_hash(strips, active, dim).first().strip_hash_hex
    h = hashlib.sha256()
    rows = {(r.venue, r.side): r for r in strips.collect()}
    for venue in ("bybit", "deribit"):
        h.update(venue.encode() + b"\0")
        for side in ("near", "next"):
            r = rows[venue, side]
            h.update(struct.pack("<3d", r.forward, r.k_zero, r.t))
            for q in r.quotes:
                h.update(struct.pack("<3d", q.strike, q.q, q.iv))
    assert got == h.hexdigest()


def test_confidence_worked_examples(spark):
    df = spark.createDataFrame([(3, 4.0, 15), (2, 20.0, 5), (3, -1.0, 8), (3, 61.0, 8)], "live int, age double, strikes int")
    got = [r[0] for r in df.select(index.confidence_score(F.col("live"), F.col("age"), F.col("strikes"))).collect()]
    assert [round(x, 2) for x in got] == [0.93, 0.28, 1.0, 0.0]


def test_truncating_division_and_wide_products(spark):
    df = spark.sql("SELECT * FROM VALUES (-7L, 2L), (7L, 2L), (7L, 0L), (9007199254740993L, 1L) t(a, b)")
    got = [None if r[0] is None else int(r[0]) for r in df.select(fx.truncated_div(F.col("a"), F.col("b"))).collect()]
    assert got == [-3, 3, None, 9007199254740993]


def test_decimal_text(spark):
    df = spark.createDataFrame([(x,) for x in ["1.5", "", "  2", "nan", "inf", "1e400", "1e-3", "-.5", "1d"]], "s string")
    got = [r[0] for r in df.select(scalar.clean_decimal(F.col("s"))).collect()]
    assert got == [1.5, None, None, None, None, None, 0.001, -0.5, None]

"""Normal distribution and option prices on the forward, as codegen-friendly Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.scalar import non_negative_part

# Hart's double-precision rational approximation of the normal tail,
# highest power first (Hart et al. 1968, algorithm 5666).
TAIL_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
# Beyond this many standard deviations the tail is below 1e-298.
TAIL_LIMIT = 37.0


def _polynomial(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def upper_tail(x: Column) -> Column:
    """P(Z > x) for x >= 0, to about 1e-15 absolute.

    The ratio of the leading coefficients is 1/sqrt(2 pi), so the same rational form keeps
    the right decay far out and needs no second branch. Kept small on purpose: generated
    methods beyond 8000 bytes of bytecode are never compiled by the JVM.
    """
    z = F.least(x, F.lit(TAIL_LIMIT))
    return F.exp(z * z * F.lit(-0.5)) * _polynomial(z, TAIL_NUMERATOR) / _polynomial(z, TAIL_DENOMINATOR)


def cdf_from_tail(x: Column, tail: Column) -> Column:
    """P(Z <= x) given ``tail`` = upper_tail(|x|)."""
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF; NaN in, NaN out."""
    return F.when(F.isnan(x), x).otherwise(cdf_from_tail(x, upper_tail(F.abs(x))))


def d_two(d1: Column, t: Column, iv: Column) -> Column:
    return d1 - iv * F.sqrt(t)


def with_option_prices(df: DataFrame, forward: Column, strike: Column, t: Column, iv: Column, rate: float = 0.0) -> DataFrame:
    """Add Black-76 ``call`` and ``put``.

    Expired or zero-vol gives discounted intrinsic value; non-positive prices give 0. Built
    step by step as columns: one nested expression would repeat its d-values dozens of times
    and outgrow what the JVM compiles.
    """
    df = df.withColumns({"_f": forward, "_k": strike, "_t": t, "_v": iv})
    f, k, years, vol = F.col("_f"), F.col("_k"), F.col("_t"), F.col("_v")
    usable = (f > 0) & ~F.isnan(f) & (k > 0) & ~F.isnan(k)
    intrinsic_only = (years <= 0) | (vol <= 0)
    d1 = (F.ln(f / F.when(usable, k)) + F.lit(0.5) * vol * vol * years) / F.when(~intrinsic_only, vol * F.sqrt(years))
    df = df.withColumn("_d1", d1)
    df = df.withColumn("_d2", d_two(F.col("_d1"), years, vol))
    df = df.withColumn("_n1", upper_tail(F.abs("_d1"))).withColumn("_n2", upper_tail(F.abs("_d2")))
    df = df.withColumn("_discount", F.exp(F.lit(-float(rate)) * years))

    def price(intrinsic: Column, value: Column) -> Column:
        amount = F.when(intrinsic_only, non_negative_part(intrinsic)).otherwise(value)
        return F.when(usable, amount * F.col("_discount")).otherwise(F.lit(0.0))

    c1, c2 = cdf_from_tail(F.col("_d1"), F.col("_n1")), cdf_from_tail(F.col("_d2"), F.col("_n2"))
    p1, p2 = cdf_from_tail(-F.col("_d1"), F.col("_n1")), cdf_from_tail(-F.col("_d2"), F.col("_n2"))
    df = df.withColumns({"call": price(f - k, f * c1 - k * c2), "put": price(k - f, k * p2 - f * p1)})
    return df.drop("_f", "_k", "_t", "_v", "_d1", "_d2", "_n1", "_n2", "_discount")

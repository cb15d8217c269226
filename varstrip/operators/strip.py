"""Dense option strips and the variance they replicate.

The spline of a chain (a few dozen knots) is solved by array folds inside its own row.
The 801-point grid is then exploded *per spline segment*, so each grid row carries the
coefficients it needs as plain columns: pricing and summation stay in generated code, and
the sum per chain needs no shuffle because the rows of a chain never left their partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.pricing import cdf_from_tail, d_two, upper_tail
from varstrip.functions.scalar import is_finite
from varstrip.params import GRID_POINTS, MAX_FITTED_IV, MIN_FITTED_IV, MIN_STRIP_QUOTES

LAST = GRID_POINTS - 1


def strip_status() -> Column:
    """First reason why a chain cannot give a strip, in checking order; else 'ok'."""
    t, f, n = F.col("t"), F.col("forward"), F.col("listed_strikes")
    k_min, k_max = F.element_at("knots", 1)["k"], F.element_at("knots", -1)["k"]
    outside = F.when(n > 0, (f < k_min) | (f > k_max)).otherwise(F.lit(False))
    return (
        F.when(~is_finite(t) | (t <= 0), F.lit("non_positive_t"))
        .when(f.isNull(), F.lit("no_two_sided_strike"))
        .when(~is_finite(f) | (f <= 0), F.lit("forward_outside_range"))
        .when(n < MIN_STRIP_QUOTES, F.lit("too_few_iv"))
        .when(outside, F.lit("forward_outside_range"))
        .otherwise(F.lit("ok"))
    )


def second_derivatives(xs: Column, ys: Column) -> Column:
    """Second derivatives of the natural cubic spline through (xs, ys), ends zero.

    Forward elimination and back substitution of the tridiagonal system as two folds. Pass
    plain array columns: an expression would be evaluated again for every element looked up.
    """
    n = F.size(xs)

    def at(a: Column, i: Column) -> Column:
        return F.get(a, i)

    def row(i: Column) -> Column:
        left, right = at(xs, i) - at(xs, i - 1), at(xs, i + 1) - at(xs, i)
        slope = (at(ys, i + 1) - at(ys, i)) / right - (at(ys, i) - at(ys, i - 1)) / left
        return F.struct(left.alias("a"), (F.lit(2.0) * (left + right)).alias("b"), right.alias("c"), (F.lit(6.0) * slope).alias("d"))

    none = F.array().cast("array<struct<b:double,c:double,d:double>>")
    rows = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 2), row)).otherwise(
        F.array().cast("array<struct<a:double,b:double,c:double,d:double>>")
    )

    def eliminate(done: Column, r: Column) -> Column:
        prior = F.get(done, F.size(done) - 1)
        w = r["a"] / prior["b"]
        reduced = F.struct(
            F.coalesce(r["b"] - w * prior["c"], r["b"]).alias("b"),
            r["c"].alias("c"),
            F.coalesce(r["d"] - w * prior["d"], r["d"]).alias("d"),
        )
        return F.concat(done, F.array(reduced))

    def substitute(solved: Column, r: Column) -> Column:
        return F.concat(solved, F.array((r["d"] - r["c"] * F.get(solved, F.size(solved) - 1)) / r["b"]))

    swept = F.aggregate(rows, none, eliminate)
    backwards = F.aggregate(F.reverse(swept), F.array(F.lit(0.0)), substitute)
    return F.reverse(F.concat(backwards, F.array(F.lit(0.0))))


def spline_at(x: Column, seg: Column) -> Column:
    """Spline value inside one segment (x0, x1, y0, y1, m0, m1)."""
    h = seg["x1"] - seg["x0"]
    a, b = (seg["x1"] - x) / h, (x - seg["x0"]) / h
    bend = (a * a * a - a) * seg["m0"] + (b * b * b - b) * seg["m1"]
    return a * seg["y0"] + b * seg["y1"] + bend * h * h / F.lit(6.0)


def fit_segments(chains: DataFrame) -> DataFrame:
    """Add ``strip_status``, the grid bounds, K0 and the spline ``segments`` of good chains."""
    df = chains.withColumn("strip_status", strip_status())
    good = F.col("strip_status") == "ok"
    df = df.withColumns(
        {
            "_ks": F.when(good, F.transform("knots", lambda q: q["k"])),
            "_ys": F.when(good, F.transform("knots", lambda q: q["iv"])),
        }
    )
    df = df.withColumn("_xs", F.transform("_ks", lambda k: F.ln(k / F.col("forward"))))
    # Repeated strikes would divide by zero further down; such a chain has no curve. Looked up
    # in the knots themselves: a filter on the status may be pushed below derived arrays.
    def log_k(i: Column) -> Column:
        return F.ln(F.get("knots", i)["k"] / F.col("forward"))

    flat = F.exists(F.sequence(F.lit(0), F.size("knots") - 2), lambda i: log_k(i + 1) <= log_k(i))
    df = df.withColumn("strip_status", F.when(good & flat, "spline_fit").otherwise(F.col("strip_status")))
    df = df.withColumns({c: F.when(good, F.col(c)) for c in ("_ks", "_xs", "_ys")})
    df = df.withColumns({"k_min": F.element_at("_ks", 1), "k_max": F.element_at("_ks", -1)})
    df = df.withColumn("step", (F.col("k_max") - F.col("k_min")) / F.lit(float(LAST)))
    df = df.withColumn("_ms", second_derivatives(F.col("_xs"), F.col("_ys")))

    def segment(i: Column) -> Column:
        def pair(column: str, name: str):
            values = F.col(column)
            return F.get(values, i).alias(f"{name}0"), F.get(values, i + 1).alias(f"{name}1")

        return F.struct(*pair("_ks", "k"), *pair("_xs", "x"), *pair("_ys", "y"), *pair("_ms", "m"),
                        (i == F.size("_ks") - 2).alias("is_last"))

    segments = F.when(good, F.transform(F.sequence(F.lit(0), F.size("_ks") - 2), segment))
    guess = F.floor((F.col("forward") - F.col("k_min")) / F.col("step"))
    k_zero_index = (
        F.when(grid_strike(guess + 1) <= F.col("forward"), guess + 1)
        .when(grid_strike(guess) > F.col("forward"), guess - 1)
        .otherwise(guess)
    )
    df = df.withColumn("segments", segments).withColumn("k_zero_index", F.least(k_zero_index, F.lit(LAST)).cast("int"))
    return df.withColumn("k_zero", grid_strike(F.col("k_zero_index"))).drop("_ks", "_xs", "_ys", "_ms")


def grid_strike(j: Column) -> Column:
    """Strike of grid point ``j``; the right end is pinned to k_max."""
    return F.when(j >= LAST, F.col("k_max")).otherwise(F.col("k_min") + F.col("step") * j)


def grid_points(fitted: DataFrame, keep: list[str], rate: float = 0.0) -> DataFrame:
    """Rows (keep..., j, strike, iv, q): the priced dense grid of every good chain.

    Chains without a strip keep a single row with NULL grid columns.
    """
    need = ["t", "forward", "k_min", "k_max", "step", "k_zero_index"]
    carried = list(dict.fromkeys([*keep, *need]))
    seg = fitted.select(*carried, F.explode_outer("segments").alias("seg"))

    def index_near(k: Column) -> Column:
        return F.ceil((k - F.col("k_min")) / F.col("step"))

    low = F.greatest(index_near(F.col("seg.k0")) - 1, F.lit(0)).cast("int")
    high = F.least(index_near(F.col("seg.k1")) + 1, F.lit(LAST)).cast("int")
    # greatest/least skip NULLs, so a chain without segments is told apart explicitly.
    indices = F.when(F.col("seg").isNotNull(), F.sequence(low, high))
    pts = seg.select(*carried, "seg", F.explode_outer(indices).alias("j"))
    pts = pts.withColumn("strike", grid_strike(F.col("j")))
    inside = (F.col("strike") >= F.col("seg.k0")) & ((F.col("strike") < F.col("seg.k1")) | F.col("seg.is_last"))
    pts = pts.filter(F.col("j").isNull() | inside)

    # One short projection per step: each becomes its own small generated method.
    f, k, t, iv = F.col("forward"), F.col("strike"), F.col("t"), F.col("iv")
    pts = pts.withColumn("_x", F.ln(k / f))
    pts = pts.withColumn("_raw", spline_at(F.col("_x"), F.col("seg"))).drop("seg")
    pts = pts.withColumn("iv", F.least(F.greatest(F.col("_raw"), F.lit(MIN_FITTED_IV)), F.lit(MAX_FITTED_IV)))
    pts = pts.withColumn("_d1", (F.lit(0.5) * iv * iv * t - F.col("_x")) / (iv * F.sqrt(t)))
    pts = pts.withColumn("_d2", d_two(F.col("_d1"), t, iv))
    d1, d2 = F.col("_d1"), F.col("_d2")
    pts = pts.withColumn("_n1", upper_tail(F.abs(d1)))
    pts = pts.withColumn("_n2", upper_tail(F.abs(d2)))
    put = k * cdf_from_tail(-d2, F.col("_n2")) - f * cdf_from_tail(-d1, F.col("_n1"))
    call = f * cdf_from_tail(d1, F.col("_n1")) - k * cdf_from_tail(d2, F.col("_n2"))
    pts = pts.withColumn("_put", put).withColumn("_call", call)
    q = (
        F.when(F.col("j") == F.col("k_zero_index"), F.lit(0.5) * (F.col("_put") + F.col("_call")))
        .when(k < f, F.col("_put"))
        .otherwise(F.col("_call"))
    )
    if rate:
        q = q * F.exp(F.lit(-float(rate)) * t)
    return pts.select(*carried, "j", "strike", "iv", q.alias("q"))


def trapezoid_weight() -> Column:
    """Weight of a grid point in the trapezoid rule."""
    j = F.col("j")
    left = F.when(j > 0, F.col("strike") - grid_strike(j - 1)).otherwise(F.lit(0.0))
    right = F.when(j < LAST, grid_strike(j + 1) - F.col("strike")).otherwise(F.lit(0.0))
    return F.lit(0.5) * (left + right)


def variance_from_integral(integral: Column, t: Column, forward: Column, k_zero: Column, rate: float = 0.0) -> Column:
    """Annualised variance from the strip integral, less the forward-vs-K0 correction."""
    t = F.when(t > 0, t)
    ratio = forward / F.when(k_zero > 0, k_zero) - F.lit(1.0)
    return F.lit(2.0) * F.exp(F.lit(float(rate)) * t) / t * integral - ratio * ratio / t


def variance_status(sigma_sq: Column, strip: Column) -> Column:
    """'ok', or why the variance is unusable (given a good strip)."""
    return (
        F.when(strip != "ok", F.lit(None).cast("string"))
        .when(~is_finite(sigma_sq), F.lit("non_finite"))
        .when(sigma_sq < 0, F.lit("negative"))
        .otherwise(F.lit("ok"))
    )


def strip_variance(chains: DataFrame, keys: list[str], carry: list[str] | None = None, rate: float = 0.0) -> DataFrame:
    """Variance of every chain: keys, strip/variance status, forward, K0, sigma_sq.

    ``keys`` identify a chain. Grouping by columns that depend on them changes nothing but
    lets them travel without a join.
    """
    extra = [c for c in (carry or []) if c not in keys]
    ids = [*keys, *extra, "t", "forward", "k_zero", "listed_strikes", "strip_status"]
    pts = grid_points(fit_segments(chains), ids, rate)
    contribution = F.col("q") / (F.col("strike") * F.col("strike")) * trapezoid_weight()
    out = pts.groupBy(*ids).agg(F.sum(contribution).alias("integral"))
    sigma = variance_from_integral(F.col("integral"), F.col("t"), F.col("forward"), F.col("k_zero"), rate)
    return out.withColumn("sigma_sq", sigma).withColumn(
        "variance_status", variance_status(F.col("sigma_sq"), F.col("strip_status"))
    )


def strip_quotes(chains: DataFrame, keys: list[str], rate: float = 0.0) -> DataFrame:
    """The full strip of every good chain as an array of (strike, q, iv), 801 long."""
    ids = [*keys, "t", "forward", "k_zero", "listed_strikes", "strip_status"]
    pts = grid_points(fit_segments(chains), ids, rate).filter(F.col("j").isNotNull())
    return pts.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("strike", "q", "iv"))).alias("quotes"))


def smile(strips: DataFrame) -> DataFrame:
    """Plottable smile of each strip: strike and IV in percent, with the forward as marker."""
    carried = [c for c in strips.columns if c != "quotes"]
    pts = strips.select(*carried, F.posexplode("quotes").alias("pos", "quote"))
    return pts.select(*carried, "pos", F.col("quote.strike").alias("strike"),
                      (F.col("quote.iv") * F.lit(100.0)).alias("iv_pct"))

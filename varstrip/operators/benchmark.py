"""Comparing an index with a published benchmark series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varstrip.functions.scalar import bucket_start
from varstrip.operators.ordered import previous, running

HIT_TOLERANCE = 0.05
PASS_SHARE = 0.95


def join_exact(results: DataFrame, candles: DataFrame, field: str = "close") -> DataFrame:
    """Benchmark at the same timestamp. 'close' looks one candle ahead, 'open' does not."""
    if field not in ("close", "open"):
        raise ValueError("benchmark field must be 'close' or 'open'")
    side = candles.select("asset", F.col("timestamp").alias("snapshot_ts"), F.col(field).alias("benchmark"))
    return results.join(side, ["asset", "snapshot_ts"])


def join_nearest(results: DataFrame, candles: DataFrame, tolerance: int = 1800, field: str = "close") -> DataFrame:
    """Benchmark at the nearest candle within ``tolerance`` seconds, NULL beyond.

    Equal distances go to the later candle. Each candle is offered to the few buckets its
    tolerance touches, so matching is an equi-join on (asset, bucket) and the sides are
    never compared as a whole.
    """
    width = max(1, tolerance)
    ts, candle = F.col("snapshot_ts"), F.col("_candle_ts")
    bucket = F.floor(F.unix_seconds(candle) / width)
    offered = candles.select("asset", F.col("timestamp").alias("_candle_ts"), F.col(field).alias("_value")).withColumn(
        "_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))
    )
    keyed = results.withColumn("_bucket", F.floor(F.unix_seconds(ts) / width))
    distance = F.abs(F.unix_micros(ts) - F.unix_micros(candle))
    # Reduce the offers per probe key first; the probe rows then join one row each.
    probes = keyed.select("asset", "snapshot_ts", "_bucket").distinct()
    near = probes.join(offered, ["asset", "_bucket"]).filter(distance <= tolerance * 1_000_000)
    best = near.groupBy("asset", "snapshot_ts").agg(
        F.min_by("_value", F.struct(distance, -F.unix_micros(candle))).alias("benchmark")
    )
    return keyed.drop("_bucket").join(best, ["asset", "snapshot_ts"], "left")


def relative_errors(df: DataFrame, value: str = "index_value", benchmark: str = "benchmark") -> DataFrame:
    """Relative and absolute error against the benchmark, and whether it is within 5 %."""
    rel = (F.col(value) - F.col(benchmark)) / F.when(F.col(benchmark) != 0, F.col(benchmark))
    df = df.filter(F.col(value).isNotNull() & F.col(benchmark).isNotNull()).withColumn("rel_err", rel)
    df = df.withColumn("abs_err", F.abs("rel_err"))
    return df.withColumn("hit", F.col("abs_err") <= HIT_TOLERANCE)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], accuracy: int = 1000) -> DataFrame:
    """One row with exact quantiles of a whole column, linear between the two nearest ranks.

    A mergeable sketch, whose rank error is at most 1 / ``accuracy`` of the rows, brackets each
    quantile. Rows below the bracket are only counted; those inside, a few thousandths, are reduced
    to distinct values with their counts, and only these are put in order. Columns of up to
    ``accuracy`` rows are not bracketed. NULLs are left out.
    """
    df = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    slack = 3.0 / accuracy  # the sketch's error, and one rank as its ranks count from one
    edges = [F.array(*[F.lit(min(1.0, max(0.0, p + s))) for p in shares.values()]) for s in (-slack, slack)]
    ends = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx("x", e, accuracy).alias(name) for e, name in zip(edges, ("_lows", "_highs"), strict=True)])
    # One row.
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items()])
    asked = ends.select("n", F.inline(F.arrays_zip(names.alias("q"), F.col("_lows").alias("low"), F.col("_highs").alias("high")))).select("n", "q.*", "low", "high")
    rows = df.withColumn("_k", F.lit(1)).join(F.broadcast(asked.groupBy(F.lit(1).alias("_k")).agg(F.collect_list(F.struct(*asked.columns)).alias("_q"))), "_k")
    few = F.col("q.n") <= accuracy
    met = rows.select("x", F.explode("_q").alias("q")).filter(few | (F.col("x") <= F.col("q.high")))
    inside = few | (F.col("x") >= F.col("q.low"))
    value = F.when(inside, F.col("x"))  # NULL stands for all rows below
    counts = met.groupBy("q", value.alias("x")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy("q").orderBy(F.col("x").asc_nulls_first())
    counts = counts.withColumns({"_upto": F.sum("c").over(order)})
    at = F.col("q.p") * (F.col("q.n") - 1)
    low, high = F.floor(at), F.ceil(at)
    pick = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("x")))
    found = counts.groupBy("q").agg(pick(low).alias("a"), pick(high).alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (at - low)
    return found.agg(*[F.max(F.when(F.col("q.name") == name, value)).alias(name) for name in shares])


def error_summary(errors: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, bias, median and p95 absolute error, share of hits; over all rows or per group.

    Groups are a day of one asset or a variant. Over all rows the quantiles are selected by rank in
    parallel, as an exact percentile of everything would be one task.
    """
    simple = [F.count("rel_err").alias("n"), F.avg("rel_err").alias("bias"), F.avg(F.col("hit").cast("double")).alias("hit_share")]
    if by:
        out = errors.groupBy(*by).agg(*simple, F.median("abs_err").alias("median_abs"), F.percentile("abs_err", F.lit(0.95)).alias("p95_abs"))
    else:
        ranks = quantiles(errors, "abs_err", {"median_abs": 0.5, "p95_abs": 0.95})
        out = errors.agg(*simple).withColumn("_k", F.lit(1)).join(F.broadcast(ranks.withColumn("_k", F.lit(1))), "_k")
    return out.select(*(by or []), "n", "bias", "median_abs", "p95_abs", "hit_share")


def correlation(df: DataFrame, by: list[str], value: str = "index_value", benchmark: str = "benchmark") -> DataFrame:
    return df.groupBy(*by).agg(F.corr(value, benchmark).alias("correlation"))


def worst_errors(errors: DataFrame, n: int = 20, tie_break: list[str] | None = None) -> DataFrame:
    """The ``n`` largest absolute errors."""
    return errors.orderBy(F.desc("abs_err"), *(tie_break or [])).limit(n)


def status_group(status: str = "status") -> Column:
    return F.split(F.col(status), ":").getItem(0)


def status_breakdown(results: DataFrame, by: list[str], groups: list[str]) -> DataFrame:
    """Rows per status group as columns, with the success rate and the 95 % verdict."""
    wide = results.withColumn("_group", status_group()).groupBy(*by).pivot("_group", groups).count().fillna(0, groups)
    total = sum((F.col(g) for g in groups[1:]), F.col(groups[0]))
    return wide.withColumn("success_rate", F.col("ok") / total).withColumn("passed", F.col("success_rate") >= PASS_SHARE)


def candle_gaps(candles: DataFrame, step_seconds: int = 3600) -> DataFrame:
    """Per asset: rows, largest gap, gaps above 1.5 steps and the two warnings."""
    month = F.date_trunc("month", F.col("timestamp"))
    df = previous(candles, ["asset"], ["timestamp"], month, {"_before": F.col("timestamp")})
    gap = (F.unix_micros("timestamp") - F.unix_micros("_before")) / F.lit(1e6)
    agg = df.withColumn("_gap", gap).groupBy("asset").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("_gap").alias("max_gap_s"),
        F.count_if(F.col("_gap") > 1.5 * step_seconds).alias("gaps"),
        F.min("close").alias("close_min"),
        F.max("close").alias("close_max"),
    )
    return agg.withColumns(
        {
            "warn_gap": F.coalesce(F.col("max_gap_s") > 24 * step_seconds, F.lit(False)),
            "warn_range": (F.col("close_min") < 1) | (F.col("close_max") > 500),
        }
    )


def clean_candles(candles: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Candles (asset, timestamp_ms, open, high, low, close) once per time, within [start, end)."""
    rest = [c for c in candles.columns if c not in ("asset", "timestamp_ms")]
    order = F.struct("seq") if "seq" in rest else F.struct(*rest)
    one = candles.groupBy("asset", "timestamp_ms").agg(F.min_by(F.struct(*rest), order).alias("_row"))
    df = one.select("asset", F.timestamp_millis("timestamp_ms").alias("timestamp"), "_row.*")
    if start is not None:
        df = df.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return df


def resample_last(rows: DataFrame, cadence: int = 60, arrival_bucket: int = 1_000_000, keys: tuple[str, ...] = ("currency",)) -> DataFrame:
    """Last row per symbol and bucket by arrival order, within each series of ``keys``.

    A late row, whose own bucket is already past, counts toward the bucket that is open when
    it arrives: the running maximum of buckets in arrival order. ``arrival_bucket`` is the
    width in ``arrival_seq`` of the pieces that running maximum is computed in.
    """
    own = bucket_start(F.col("timestamp"), cadence)
    piece = F.floor(F.col("arrival_seq") / arrival_bucket)
    df = running(rows, [*keys], ["arrival_seq", "symbol"], piece, {"bucket": ("max", own)})
    rest = [c for c in df.columns if c not in (*keys, "symbol", "bucket", "timestamp")]
    last = F.max_by(F.struct(*rest), F.struct("arrival_seq", "timestamp")).alias("_row")
    out = df.groupBy(*keys, "symbol", "bucket").agg(last)
    return out.select(*keys, "symbol", F.col("bucket").alias("timestamp"), "_row.*")


def stage_diff(left: DataFrame, right: DataFrame, keys: list[str], stages: list[tuple[str, float]]) -> DataFrame:
    """Compare two runs stage by stage and name the first that differs beyond its tolerance.

    ``stages`` is an ordered list of (column, tolerance). A value present on one side only
    differs.
    """
    renamed = right.select(*keys, *[F.col(s).alias(f"_r_{s}") for s, _ in stages], F.lit(True).alias("_right"))
    both = left.select(*keys, *[s for s, _ in stages], F.lit(True).alias("_left")).join(renamed, keys, "full")

    def differs(s: str, tol: float) -> Column:
        a, b = F.col(s), F.col(f"_r_{s}")
        return F.when(a.isNull() & b.isNull(), F.lit(False)).when(a.isNull() | b.isNull(), F.lit(True)).otherwise(
            F.abs(a - b) > tol
        )

    first = None
    for name, tol in stages:
        test = differs(name, tol)
        first = F.when(test, name) if first is None else first.when(test, name)
    missing = F.when(F.col("_left").isNull(), "left_missing").when(F.col("_right").isNull(), "right_missing")
    diffs = [F.abs(F.col(s) - F.col(f"_r_{s}")).alias(f"{s}_diff") for s, _ in stages]
    return both.select(*keys, *diffs, F.coalesce(missing, first, F.lit("equal")).alias("first_divergence"))

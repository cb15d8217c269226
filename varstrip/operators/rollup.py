"""OHLC rollups of a published series and the figures charts show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varstrip.functions.scalar import bucket_start, packed_order
from varstrip.operators.ordered import previous
from varstrip.params import HISTORY_DEFAULT_LIMIT, HISTORY_INTERVALS, HISTORY_MAX_LIMIT, TIMEFRAMES


# Bars of one index are ranked in pieces of so much time.
PIECE_SECONDS = 30 * 86_400


def tick_order(order: list[str] | None) -> Column:
    """Order of ticks: a timestamp column, and a sequence number if given."""
    when, *sequence = order or ["ts"]
    return packed_order(F.unix_micros(when), F.col(sequence[0]) if sequence else None)


def minute_bars(ticks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One-minute OHLC per index with mergeable parts.

    Open and close keep their times, and confidence its sum and count, so that bars of the
    same minute from several batches merge exactly (``merge_bars``).
    """
    by = tick_order(order)
    return ticks.groupBy("index_id", bucket_start(F.col("ts"), 60).alias("bucket")).agg(
        F.min_by("value", by).alias("open"),
        F.min(by).alias("open_at"),
        F.max_by("value", by).alias("close"),
        F.max(by).alias("close_at"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).alias("count"),
        F.sum("confidence").alias("confidence_sum"),
    )


def merge_bars(bars: DataFrame) -> DataFrame:
    """Merge partial minute bars; a no-op on bars that are already whole."""
    return bars.groupBy("index_id", "bucket").agg(
        F.min_by("open", "open_at").alias("open"),
        F.min("open_at").alias("open_at"),
        F.max_by("close", "close_at").alias("close"),
        F.max("close_at").alias("close_at"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("count").alias("count"),
        F.sum("confidence_sum").alias("confidence_sum"),
    )


def avg_confidence() -> Column:
    return F.col("confidence_sum") / F.col("count")


def history(bars: DataFrame, interval: str = "1m") -> DataFrame:
    """Re-bucket minute bars. Confidence is the plain mean of the minutes' averages."""
    if interval not in HISTORY_INTERVALS:
        raise ValueError(f"invalid interval {interval!r}; allowed are {', '.join(HISTORY_INTERVALS)}")
    start = bucket_start(F.col("bucket"), HISTORY_INTERVALS[interval] * 60)
    return bars.withColumn("_avg", avg_confidence()).groupBy("index_id", start.alias("ts")).agg(
        F.min_by("open", "bucket").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bucket").alias("close"),
        F.sum("count").alias("count"),
        F.avg("_avg").alias("avg_confidence"),
    )


def check_limit(limit: int) -> int:
    if not 1 <= limit <= HISTORY_MAX_LIMIT:
        raise ValueError(f"limit must be an integer in [1, {HISTORY_MAX_LIMIT}]")
    return limit


def latest_bars(bars: DataFrame, limit: int = HISTORY_DEFAULT_LIMIT, index_id: str | None = None) -> DataFrame:
    """The newest ``limit`` bars, oldest first; of one index, or of each."""
    check_limit(limit)
    if index_id is not None:
        newest = bars.filter(F.col("index_id") == index_id).orderBy(F.desc("ts")).limit(limit)
        return newest.orderBy("ts")
    # Of every piece of time only its newest ones go on, so that a key's last step has few rows.
    day = bucket_start(F.col("ts"), PIECE_SECONDS).alias("_piece")
    counts = bars.groupBy("index_id", day).agg(F.count(F.lit(1)).alias("_n"))
    after = F.expr("sum(_n) OVER (PARTITION BY index_id ORDER BY _piece DESC) - _n")
    wanted = counts.withColumn("_after", after).filter(F.col("_after") < limit).drop("_n")
    rows = bars.withColumn("_piece", bucket_start(F.col("ts"), PIECE_SECONDS)).join(wanted, ["index_id", "_piece"])
    newest_first = Window.partitionBy("index_id", "_piece").orderBy(F.desc("ts"))
    rank = F.row_number().over(newest_first) + F.col("_after")
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank", "_piece", "_after")


def timeframe(bars: DataFrame, name: str, index_id: str | None = None) -> DataFrame:
    """A chart preset: interval and number of bars by name."""
    interval, limit = TIMEFRAMES[name]
    return latest_bars(history(bars, interval), limit, index_id)


def latest_value(ticks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The newest row of each index."""
    rest = [c for c in ticks.columns if c != "index_id"]
    by = tick_order(order)
    return ticks.groupBy("index_id").agg(*[F.max_by(c, by).alias(c) for c in rest])


def series_stats(bars: DataFrame) -> DataFrame:
    """Open, close, range, change and count-weighted confidence of each bar series."""
    counted = F.when(F.col("avg_confidence") > 0, F.col("count"))
    agg = bars.groupBy("index_id").agg(
        F.min_by("open", "ts").alias("open"),
        F.max_by("close", "ts").alias("close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("count").alias("total_ticks"),
        F.sum(F.col("avg_confidence") * counted).alias("_weighted"),
        F.sum(counted).alias("_counted"),
    )
    change = F.when(F.col("open") == 0, F.lit(0.0)).otherwise(
        (F.col("close") - F.col("open")) / F.when(F.col("open") != 0, F.col("open")) * F.lit(100.0)
    )
    return agg.withColumns(
        {"change_pct": change, "avg_confidence": F.coalesce(F.col("_weighted") / F.col("_counted"), F.lit(0.0))}
    ).drop("_weighted", "_counted")


def bar_moves(bars: DataFrame) -> DataFrame:
    """Change in percent of the open and range of every bar; no change where the open is 0."""
    nonzero = F.when(F.col("open") != 0, F.col("open"))
    return bars.withColumns(
        {"change_pct": (F.col("close") - F.col("open")) / nonzero * F.lit(100.0), "range": F.col("high") - F.col("low")}
    )


def first_to_last(bars: DataFrame, value: str = "close") -> DataFrame:
    """Difference between the last and the first value of each series, absolute and in percent."""
    agg = bars.groupBy("index_id").agg(F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"))
    agg = agg.withColumn("delta", F.col("last") - F.col("first"))
    pct = F.col("delta") / F.when(F.col("first") != 0, F.col("first")) * F.lit(100.0)
    tone = F.when(pct.isNull(), "neutral").when(pct >= 0, "up").otherwise("down")
    return agg.withColumns({"delta_pct": pct, "tone": tone})


def tick_direction(ticks: DataFrame, order: list[str] | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """Up or down against the previous tick of the index; NULL where it did not move."""
    df = previous(
        ticks, ["index_id"], order or ["ts"], bucket_start(F.col("ts"), bucket_seconds), {"previous_value": F.col("value")}
    )
    moved = F.when(F.col("value") > F.col("previous_value"), "up").when(F.col("value") < F.col("previous_value"), "down")
    return df.withColumn("direction", moved)


def ema_overlay(bars: DataFrame) -> DataFrame:
    """Exponential moving average of the close over a displayed series.

    The period is a sixth of the series, within 4 to 20 bars; the first value is the plain
    mean of the first period. Input is what a chart shows (``latest_bars``), at most
    HISTORY_MAX_LIMIT bars per index, so a series fits one row's array.
    """
    series = bars.groupBy("index_id").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("s"))
    n = F.size("s")
    series = series.withColumn("period", F.least(F.lit(20), F.greatest(F.lit(4), F.floor(n / 6))).cast("int"))
    period = F.col("period")
    head = F.slice("s", F.lit(1), F.least(period, n))
    seed = F.aggregate(head, F.lit(0.0), lambda acc, r: acc + r["close"]) / period
    k = F.lit(2.0) / (period + F.lit(1.0))
    start = F.struct(seed.alias("last"), F.array(seed).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        nxt = r["close"] * k + acc["last"] * (F.lit(1.0) - k)
        return F.struct(nxt.alias("last"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    tail = F.when(n > period, F.slice("s", period + 1, F.greatest(n - period, F.lit(0)))).otherwise(
        F.slice("s", F.lit(1), F.lit(0))
    )
    series = series.withColumn("_ema", F.aggregate(tail, start, step)["out"])
    rows = series.select("index_id", "period", "_ema", F.posexplode("s").alias("i", "bar"))
    value = F.when(F.col("i") >= F.col("period") - 1, F.get("_ema", F.col("i") - F.col("period") + 1))
    return rows.select("index_id", F.col("bar.ts").alias("ts"), F.col("bar.close").alias("close"), "period", value.alias("ema"))


def patch_live_bar(bars: DataFrame, latest: DataFrame) -> DataFrame:
    """Fold the newest tick (index_id, value, ts) of each index into its last bar.

    A tick older than the start of the last bar changes nothing. One row per index is
    enough to know both the tick and the last bar.
    """
    last_bar = bars.groupBy("index_id").agg(F.max("ts").alias("_last_ts"))
    live = latest.select("index_id", F.col("value").alias("_value"), F.col("ts").alias("_tick_ts"))
    df = bars.join(last_bar.join(live, "index_id", "left"), "index_id", "left")
    hit = F.coalesce((F.col("ts") == F.col("_last_ts")) & (F.col("_tick_ts") >= F.col("ts")), F.lit(False))
    return df.withColumns(
        {
            "high": F.when(hit, F.greatest("high", "_value")).otherwise(F.col("high")),
            "low": F.when(hit, F.least("low", "_value")).otherwise(F.col("low")),
            "close": F.when(hit, F.col("_value")).otherwise(F.col("close")),
        }
    ).drop("_last_ts", "_value", "_tick_ts")

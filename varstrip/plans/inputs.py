"""Option-market inputs derived from the ``events`` table.

Every builder reads the whole table and grows with it. The same rows are rebuilt in SQL by
``oracle/ctes.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrip.functions.scalar import bucket_start, to_millis
from varstrip.params import INDEX_DIMENSION

UNDERLYING = 80.0
FORWARD = 101.3
HOUR = 3600


def c(name: str) -> Column:
    return F.col(name)


def seconds_after(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + (seconds.cast("double") * F.lit(1e6)).cast("bigint"))


def days_after(ts: Column, days: Column) -> Column:
    return seconds_after(ts, days * F.lit(86_400))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select(
        "event_id",
        to_millis(c("ts").cast("timestamp")).alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def venue_of(event_id: Column) -> Column:
    return F.when(event_id % 3 == 0, "bybit").when(event_id % 3 == 1, "deribit").otherwise("okx")


def asset_of(user_id: Column) -> Column:
    return F.when(user_id % 2 == 0, "btc").otherwise("eth")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with arrival times, crossed, wide and stale quotes, and duplicate copies."""
    spread = (c("k") % 40) / F.lit(200.0)
    crossed = (c("event_type") == "error") & (c("k") % 5 == 0)
    bid = F.when(c("k") % 10 == 9, F.lit(None)).when(crossed, c("value") * 1.01).otherwise(c("value") * (F.lit(1.0) - spread))
    ask = F.when(c("k") % 10 == 8, F.lit(None)).when(crossed, c("value") * 0.99).otherwise(c("value") * (F.lit(1.0) + spread))
    day = bucket_start(c("ts"), 86_400)
    once = events(spark, sf_dir).select(
        c("event_id").alias("seq"),
        venue_of(c("event_id")).alias("venue"),
        asset_of(c("user_id")).alias("asset"),
        seconds_after(day, F.lit(23 * 86_400 + 8 * HOUR)).alias("expiry"),
        (F.lit(20.0) + F.lit(5.0) * (c("user_id") % 25)).alias("strike"),
        F.when(c("event_id") % 2 == 0, "call").otherwise("put").alias("kind"),
        bid.alias("bid"),
        ask.alias("ask"),
        (F.lit(0.3) + c("k") / F.lit(200.0)).alias("iv"),
        F.lit(UNDERLYING).alias("underlying"),
        c("k").cast("double").alias("open_interest"),
        c("value").alias("volume_24h"),
        c("ts").alias("received_at"),
        c("ts"),
        (c("k") % 7).alias("delay"),
    )
    copies = F.when(c("seq") % 10 == 0, F.array(F.lit(0.0), F.lit(0.5))).otherwise(F.array(F.lit(0.0)))
    ticks = once.withColumn("copy", F.explode(copies))
    return ticks.withColumns(
        {
            "mid": (c("bid") + c("ask")) * F.lit(0.5),
            "arrival_ts": seconds_after(c("received_at"), c("delay") + c("copy")),
        }
    ).drop("delay", "copy")


def chain_base(spark: SparkSession, sf_dir: str, cadence: int = HOUR) -> DataFrame:
    """One row per (snapshot, venue, asset) with its level of volatility."""
    ev = events(spark, sf_dir)
    snapshot = seconds_after(bucket_start(c("ts"), cadence), F.lit(cadence))
    grouped = ev.groupBy(
        snapshot.alias("snapshot_ts"), venue_of(c("event_id")).alias("venue"), asset_of(c("user_id")).alias("asset")
    ).agg(
        F.sum(F.round(c("value") * 100).cast("bigint")).alias("cents"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.unix_millis("ts")).alias("last_ms"),
    )
    return grouped.select(
        "snapshot_ts",
        "venue",
        "asset",
        (F.lit(0.25) + (c("cents") / c("n")) / F.lit(20_000.0)).alias("iv0"),
        F.timestamp_millis(F.unix_millis("snapshot_ts") - c("last_ms") % 30_000).alias("latest_ts"),
        (c("cents") % 29).alias("defect"),
    )


def chain_legs(spark: SparkSession, sf_dir: str, cadence: int = HOUR) -> DataFrame:
    """Call and put quotes per strike that satisfy put-call parity, with some broken chains.

    The defects give every rejection path its share of rows: missing expiries, thin chains,
    unquoted puts, calls without IV, and strikes that do not reach the forward.
    """
    base = chain_base(spark, sf_dir, cadence)
    tenors = F.array(*[F.lit(d) for d in (10, 23, 30, 37, 65)])
    legs = base.withColumn("days", F.explode(tenors)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(40))))
    legs = legs.withColumn("strike", (F.lit(40) + 4 * c("i")).cast("double"))
    d, days = c("defect"), c("days")
    keep = ~(
        ((d == 0) & (days < 30))
        | ((d == 1) & (days > 30))
        | ((d == 2) & (days != 30))
        | ((d == 3) & (days < 30) & (c("i") % 11 != 0))
        | ((d == 6) & (days < 30) & (c("strike") < FORWARD))
    )
    legs = legs.filter(keep)
    t = days / F.lit(365.0)
    f = F.lit(FORWARD)
    x = F.ln(c("strike") / f)
    legs = legs.withColumn("x", x).withColumn("iv", c("iv0") * (F.lit(1.0) + F.lit(0.1) * c("x") * c("x")))
    time_value = F.lit(0.4) * f * c("iv") * F.sqrt(t) * F.exp(-c("x") * c("x") / (F.lit(2.0) * c("iv") * c("iv") * t))
    legs = legs.withColumn("tv", time_value)
    call = F.greatest(f - c("strike"), F.lit(0.0)) + c("tv")
    put = F.greatest(c("strike") - f, F.lit(0.0)) + c("tv")
    return legs.select(
        "snapshot_ts",
        "venue",
        "asset",
        days_after(c("snapshot_ts"), days).alias("expiry"),
        "strike",
        call.alias("call_mid"),
        F.when(~((d == 4) & (days > 30)), put).alias("put_mid"),
        F.when(d != 5, c("iv")).alias("call_iv"),
        c("iv").alias("put_iv"),
        "latest_ts",
    )


def chain_quotes(spark: SparkSession, sf_dir: str, cadence: int = HOUR) -> DataFrame:
    """``chain_legs`` as one row per instrument, the way the latest-quote step emits them."""
    legs = chain_legs(spark, sf_dir, cadence)
    sides = F.array(
        F.struct(F.lit("call").alias("kind"), c("call_mid").alias("mid"), c("call_iv").alias("iv")),
        F.struct(F.lit("put").alias("kind"), c("put_mid").alias("mid"), c("put_iv").alias("iv")),
    )
    keys = ["snapshot_ts", "venue", "asset", "expiry", "strike", "latest_ts"]
    return legs.select(*keys, F.inline(sides))


def index_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(INDEX_DIMENSION), "index_id string, asset string")


def index_of(user_id: Column) -> Column:
    out = None
    for index_id, asset in INDEX_DIMENSION:
        test = asset_of(user_id) == asset
        out = F.when(test, index_id) if out is None else out.when(test, index_id)
    return out


def index_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published index series."""
    return events(spark, sf_dir).select(
        index_of(c("user_id")).alias("index_id"),
        "value",
        (c("k") / F.lit(100.0)).alias("confidence"),
        F.sha2(c("event_id").cast("string"), 256).alias("strip_hash_hex"),
        "ts",
        c("event_id").alias("seq"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles per asset; hours without an event are missing."""
    ev = events(spark, sf_dir)
    by = F.struct("ts", "event_id")
    level = F.lit(20.0) + c("value") / F.lit(10.0)
    return ev.groupBy(asset_of(c("user_id")).alias("asset"), bucket_start(c("ts"), HOUR).alias("timestamp")).agg(
        F.min_by(level, by).alias("open"),
        F.max(level).alias("high"),
        F.min(level).alias("low"),
        F.max_by(level, by).alias("close"),
    )


def history_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical snapshot rows of every venue in coin prices, in arrival order, some of them late."""
    legs = chain_quotes(spark, sf_dir)
    i = ((c("strike") - 40) / 4).cast("int")
    coin = c("mid") / F.lit(100.0)
    rows = legs.select(
        c("snapshot_ts").alias("timestamp"),
        F.concat_ws(
            "-",
            F.upper("asset"),
            F.upper(F.date_format("expiry", "dMMMyy")),
            c("strike").cast("int").cast("string"),
            F.when(c("kind") == "call", "C").otherwise("P"),
        ).alias("symbol"),
        "venue",
        c("asset").alias("currency"),
        c("kind").alias("type"),
        c("strike").alias("strike_price"),
        c("expiry").alias("expiration"),
        F.when(i % 13 == 0, F.lit(0.0)).otherwise(coin * F.lit(0.99)).alias("bid_price"),
        (coin * F.lit(1.01)).alias("ask_price"),
        coin.alias("mark_price"),
        (c("iv") * F.lit(100.0)).alias("mark_iv"),
        i.alias("i"),
    )
    # Two updates per instrument and hour; every 17th strike's second one is an hour late.
    late = (c("i") % 17 == 5) & (c("u") == 1)
    updates = rows.withColumn("u", F.explode(F.array(F.lit(0), F.lit(1))))
    arrival = F.unix_seconds("timestamp") * 10 + c("u") * 5 + c("i") % 3
    return updates.select(
        F.when(late, seconds_after(c("timestamp"), F.lit(-1800))).otherwise(c("timestamp")).alias("timestamp"),
        "symbol",
        "venue",
        "currency",
        "type",
        "strike_price",
        "expiration",
        "bid_price",
        (c("ask_price") + c("u") * F.lit(0.01)).alias("ask_price"),
        "mark_price",
        "mark_iv",
        # The spot moves from update to update.
        (F.lit(100.0) + (arrival % 7) * F.lit(0.125)).alias("underlying_price"),
        arrival.alias("arrival_seq"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to open a position; collateral in 6-decimal units, before any fee."""
    ev = events(spark, sf_dir).filter(c("event_type") == "purchase")
    return ev.select(
        c("event_id").alias("id"),
        F.concat(F.lit("0xAb"), F.lpad(c("user_id").cast("string"), 4, "0")).alias("trader"),
        index_of(c("user_id")).alias("index_id"),
        (c("event_id") % 2 == 0).alias("is_long"),
        F.round(c("value") * 1_000_000).cast("bigint").alias("collateral"),
        (1 + c("k") % 10).cast("bigint").alias("leverage"),
        F.unix_seconds("ts").alias("opened_at"),
        ((F.lit(4000) + c("k").cast("bigint") * 20) * 1_000_000).alias("stop_price"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to end a position: every third by its owner after two days, and liquidators who
    try every position after one and after three days."""
    rows = requests(spark, sf_dir)
    day = lambda n: (c("opened_at") + n * 86_400).alias("at")
    ref = F.lit(0).cast("bigint").alias("ref")
    own = rows.filter(c("id") % 3 == 0).select("id", day(2), F.lit("close").alias("kind"), ref)
    liquidators = [rows.select("id", day(n), F.lit("liquidate").alias("kind"), ref) for n in (1, 3)]
    return own.unionByName(liquidators[0]).unionByName(liquidators[1])


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index marks in 1e8 fixed point, 40 to 60 points and more."""
    ticks = index_ticks(spark, sf_dir)
    scaled = ((F.lit(4000) + F.round(c("value") * 10).cast("bigint")) * 1_000_000).cast("bigint")
    return ticks.select("index_id", "seq", F.unix_seconds("ts").alias("at"), scaled.alias("mark"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional orders: limit opens, and take-profits and stop-losses of a quarter of the requests.

    Every eighth stop names its position too late to matter: after another two days.
    """
    ev = events(spark, sf_dir).filter(c("event_type") == "signup")
    trader = F.concat(F.lit("0xAb"), F.lpad(c("user_id").cast("string"), 4, "0"))
    limits = ev.select(
        c("event_id").alias("order_id"),
        trader.alias("trader"),
        index_of(c("user_id")).alias("index_id"),
        F.lit("limit").alias("kind"),
        F.lit(None).cast("bigint").alias("position_id"),
        ((F.lit(4000) + c("k").cast("bigint") * 20) * 1_000_000).alias("trigger_price"),
        (c("event_id") % 2 == 0).alias("trigger_above"),
        F.unix_seconds("ts").alias("placed_at"),
    )
    stops = requests(spark, sf_dir).filter(c("id") % 4 < 1).select(
        c("id").alias("order_id"), "trader", "index_id", F.when(c("id") % 8 == 0, "tp").otherwise("sl").alias("kind"), c("id").alias("position_id"),
        c("stop_price").alias("trigger_price"), (c("id") % 8 == 0).alias("trigger_above"),
        (c("opened_at") + F.when(c("id") % 32 == 0, 2 * 86_400 + 1).otherwise(600)).alias("placed_at"),
    )
    return limits.unionByName(stops)


def vault_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LP deposits (clicks) and withdrawals (views, a third of the size)."""
    ev = events(spark, sf_dir).filter(c("event_type").isin("click", "view"))
    amount = F.round(c("value") * 1_000_000).cast("bigint")
    deposit = c("event_type") == "click"
    return ev.select(
        c("event_id").alias("seq"),
        F.concat(F.lit("0xAb"), F.lpad(c("user_id").cast("string"), 4, "0")).alias("holder"),
        F.unix_seconds("ts").alias("at"),
        F.when(deposit, "deposit").otherwise("withdraw").alias("event_type"),
        F.when(deposit, amount * 3).otherwise((amount - amount % 3) / 3).cast("bigint").alias("assets"),
    )

"""Venue frames as JSON text, built from the derived ticks, with some malformed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrip.plans import inputs


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the fields the frames need and a defect class ``k % 20``."""
    ev = inputs.events(spark, sf_dir)
    day = F.to_date("ts")
    return ev.select(
        F.col("event_id").alias("seq"),
        "k",
        "value",
        F.unix_millis("ts").alias("ms"),
        F.when(F.col("user_id") % 2 == 0, "BTC").otherwise("ETH").alias("coin"),
        F.add_months(F.date_add(day, 23), 36).alias("expiry_day"),
        (F.lit(20) + F.lit(5) * (F.col("user_id") % 25)).alias("strike"),
        F.when(F.col("event_id") % 2 == 0, "C").otherwise("P").alias("cp"),
        (F.col("k") % 20).alias("defect"),
    )


def _day_month_year():
    return F.upper(F.date_format("expiry_day", "dMMMyy"))


def deribit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _named(spark, sf_dir)
    name = F.concat_ws("-", F.when(F.col("defect") == 1, "SOL").otherwise(F.col("coin")), _day_month_year(), F.col("strike").cast("string"), "cp")
    name = F.when(F.col("defect") == 2, F.concat(name, F.lit("-X"))).otherwise(name)
    data = F.struct(
        F.when(F.col("k") % 10 != 9, F.col("value")).alias("best_bid_price"),
        F.when(F.col("k") % 10 != 8, F.col("value") * 1.25).alias("best_ask_price"),
        (F.lit(30.0) + F.col("k") / 2.0).alias("mark_iv"),
        F.when(F.col("defect") != 3, F.lit(80.0)).alias("underlying_price"),
        F.col("k").cast("double").alias("open_interest"),
        F.struct(F.col("value").alias("volume")).alias("stats"),
        F.col("ms").alias("timestamp"),
    )
    params = F.struct(F.concat(F.lit("ticker."), name, F.lit(".100ms")).alias("channel"), data.alias("data"))
    frame = F.to_json(F.struct(F.lit("subscription").alias("method"), params.alias("params")))
    ack = F.lit('{"jsonrpc":"2.0","id":1,"result":["ticker.X.100ms"]}')
    return ev.select("seq", F.when(F.col("defect") == 4, ack).when(F.col("defect") == 5, "not json").otherwise(frame).alias("frame"))


def okx_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _named(spark, sf_dir)
    date = F.when(F.col("defect") == 1, "991332").otherwise(F.date_format("expiry_day", "yyMMdd"))
    name = F.concat_ws("-", "coin", F.when(F.col("defect") == 2, "EUR").otherwise("USD"), date, F.col("strike").cast("string"), "cp")

    def row(inst_type: str, instrument):
        return F.struct(
            F.lit(inst_type).alias("instType"),
            instrument.alias("instId"),
            F.when(F.col("k") % 10 == 9, "").otherwise((F.lit(0.3) + F.col("k") / 200.0).cast("string")).alias("markVol"),
            F.when(F.col("k") % 10 == 8, "n/a").otherwise("75156.25").alias("fwdPx"),
            F.when(F.col("defect") == 3, "soon").otherwise(F.col("ms").cast("string")).alias("ts"),
        )

    frame = F.to_json(F.struct(F.array(row("OPTION", name), row("SWAP", name)).alias("data")))
    ack = F.lit('{"event":"subscribe","arg":{"channel":"opt-summary"}}')
    return ev.select("seq", F.when(F.col("defect") == 4, ack).otherwise(frame).alias("frame"))


def bybit_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _named(spark, sf_dir)
    strike = F.when(F.col("defect") == 1, "abc").otherwise(F.col("strike").cast("string"))
    quote = F.when(F.col("defect") == 2, "USDC").otherwise("USDT")
    name = F.concat_ws("-", F.col("coin"), _day_month_year(), strike, F.col("cp"), quote)
    text = F.col("value").cast("string")
    data = F.struct(
        name.alias("symbol"),
        F.when(F.col("k") % 10 == 9, "").otherwise(text).alias("bidPrice"),
        F.when(F.col("k") % 10 != 8, (F.col("value") * 1.25).cast("string")).alias("askPrice"),
        F.lit("0.5").alias("bidIv"),
        F.when(F.col("k") % 4 != 1, "0.75").alias("askIv"),
        F.when(F.col("k") % 4 > 1, (F.lit(0.3) + F.col("k") / 200.0).cast("string")).otherwise("").alias("markPriceIv"),
        F.when(F.col("k") % 3 == 0, "75007.5").otherwise("").alias("indexPrice"),
        F.when(F.col("k") % 3 == 1, "75006.25").alias("underlyingPrice"),
        F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("openInterest"),
        F.lit("inf").alias("volume24h"),
    )
    frame = F.to_json(
        F.struct(
            F.concat(F.lit("tickers."), name).alias("topic"),
            F.when(F.col("defect") != 3, F.col("ms")).alias("ts"),
            F.lit("snapshot").alias("type"),
            data.alias("data"),
        )
    )
    ack = F.lit('{"success":true,"type":"COMMAND_RESP","op":"subscribe"}')
    return ev.select("seq", F.when(F.col("defect") == 4, ack).otherwise(frame).alias("frame"))


def instrument_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in every venue's grammar with one defect each where ``k % 12`` says so."""
    ev = _named(spark, sf_dir)
    d = F.col("k") % 12
    coin = F.when(d == 1, "SOL").when(d == 2, "btc").otherwise(F.col("coin"))
    dmy = F.when(d == 3, "30FOO27").when(d == 4, "31JUN27").when(d == 5, "1JAN24").otherwise(_day_month_year())
    ymd = F.when(d == 3, "2707").when(d == 4, "270631").when(d == 5, "240101").otherwise(F.date_format("expiry_day", "yyMMdd"))
    strike = F.when(d == 6, "1e5x").when(d == 7, "").otherwise(F.col("strike").cast("string"))
    cp = F.when(d == 8, "X").otherwise(F.col("cp"))
    quote = F.when(d == 9, "EUR")
    names = F.array(
        F.struct(F.lit("deribit").alias("venue"), F.concat_ws("-", coin, dmy, strike, cp).alias("name")),
        F.struct(F.lit("okx").alias("venue"), F.concat_ws("-", coin, F.coalesce(quote, F.lit("USD")), ymd, strike, cp).alias("name")),
        F.struct(F.lit("bybit").alias("venue"), F.concat_ws("-", coin, dmy, strike, cp, F.coalesce(quote, F.lit("USDT"))).alias("name")),
    )
    rows = ev.select("seq", d.alias("d"), F.inline(names))
    return rows.select("seq", "venue", F.when(F.col("d") == 10, F.concat("name", F.lit("-Z"))).otherwise(F.col("name")).alias("name"))


def history_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historical chain rows as the text columns of a CSV file."""
    ev = _named(spark, sf_dir)
    prefix = F.when(F.col("defect") == 1, "BTC_USDC").when(F.col("defect") == 2, "SOL").otherwise(F.col("coin"))
    v = F.col("value").cast("string")
    return ev.select(
        "seq",
        (F.col("ms") * 1000 + F.col("k")).cast("string").alias("timestamp"),
        F.concat_ws("-", prefix, _day_month_year(), F.col("strike").cast("string"), "cp").alias("symbol"),
        F.when(F.col("cp") == "C", "call").otherwise("put").alias("type"),
        F.col("strike").cast("string").alias("strike_price"),
        F.when(F.col("k") % 9 == 0, "").otherwise((F.col("ms") * 1000 + 86_400_000_000).cast("string")).alias("expiration"),
        F.when(F.col("k") % 10 == 9, "").otherwise(v).alias("bid_price"),
        F.when(F.col("k") % 10 == 7, "x1").otherwise(v).alias("bid_amount"),
        F.when(F.col("k") % 10 == 8, "nan").otherwise(v).alias("ask_price"),
        v.alias("ask_amount"),
        v.alias("mark_price"),
        F.col("k").cast("string").alias("mark_iv"),
        F.lit("80.5").alias("underlying_price"),
    )

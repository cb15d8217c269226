"""Captured venue frames (one JSON text per row) to normalised option ticks.

Each decoder keeps control frames out, keeps every data row, and names the reason in
``reject_reason`` where a row cannot become a tick, so that nothing vanishes silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip import schemas
from varstrip.functions.instruments import decompose
from varstrip.functions.scalar import clean_decimal, clean_long, once, two_sided_mid

NAN = float("nan")


def _as_ticks(df: DataFrame, venue: str, reason: Column, **values: Column) -> DataFrame:
    """Common tick layout; the passed-through input columns other than frames are kept."""
    fields = {
        "venue": F.lit(venue),
        "asset": F.col("name.asset"),
        "expiry": F.col("name.expiry"),
        "strike": F.col("name.strike"),
        "kind": F.col("name.kind"),
        **values,
    }
    reason = F.when(F.col("name.reason").isNotNull(), F.concat(F.lit("name_"), F.col("name.reason"))).otherwise(reason)
    carried = [c for c in df.columns if c not in {"frame", "msg", "name", "row", "instrument"}]
    return df.select(
        *carried,
        *[fields[c].alias(c) for c in schemas.TICK_COLUMNS],
        reason.alias("reject_reason"),
    )


def decode_deribit(frames: DataFrame) -> DataFrame:
    """Subscription ticker frames; prices are in coin and become USD, IV is in percent."""
    msg = once(frames, "msg", F.from_json("frame", schemas.DERIBIT_FRAME))
    msg = msg.filter(
        (F.col("msg.method") == "subscription")
        & F.col("msg.error").isNull()
        & F.col("msg.params.channel").startswith("ticker.")
    )
    channel = F.col("msg.params.channel")
    msg = msg.withColumn("instrument", F.regexp_extract(channel, r"^ticker\.(.*)\.[^.]*$", 1))
    msg = once(msg, "name", decompose(F.col("instrument"), "deribit"))
    data = F.col("msg.params.data")
    usd_bid = data["best_bid_price"] * data["underlying_price"]
    usd_ask = data["best_ask_price"] * data["underlying_price"]
    missing = (
        data["underlying_price"].isNull()
        | data["open_interest"].isNull()
        | data["stats"]["volume"].isNull()
        | data["timestamp"].isNull()
    )
    return _as_ticks(
        msg,
        "deribit",
        F.when(missing, F.lit("payload")),
        bid=usd_bid,
        ask=usd_ask,
        mid=two_sided_mid(usd_bid, usd_ask),
        iv=data["mark_iv"] / F.lit(100.0),
        underlying=data["underlying_price"],
        open_interest=data["open_interest"],
        volume_24h=data["stats"]["volume"],
        received_at=F.timestamp_millis(data["timestamp"]),
    )


def decode_okx(frames: DataFrame) -> DataFrame:
    """Option summary pushes: many rows per frame, no prices, IV already a fraction."""
    msg = once(frames, "msg", F.from_json("frame", schemas.OKX_FRAME)).filter(F.col("msg.event").isNull())
    rows = msg.withColumn("row", F.explode("msg.data")).filter(F.col("row.instType") == "OPTION")
    rows = once(rows, "name", decompose(F.col("row.instId"), "okx"))
    millis = clean_long(F.col("row.ts"))
    nothing = F.lit(None).cast("double")
    return _as_ticks(
        rows,
        "okx",
        F.when(millis.isNull(), F.lit("timestamp")),
        bid=nothing,
        ask=nothing,
        mid=nothing,
        iv=clean_decimal(F.col("row.markVol")),
        underlying=F.coalesce(clean_decimal(F.col("row.fwdPx")), F.lit(NAN)),
        open_interest=F.lit(0.0),
        volume_24h=F.lit(0.0),
        received_at=F.timestamp_millis(millis),
    )


def decode_bybit(frames: DataFrame) -> DataFrame:
    """Ticker pushes in USD; the mark IV wins over the two-sided IV midpoint."""
    msg = once(frames, "msg", F.from_json("frame", schemas.BYBIT_FRAME))
    ack = F.coalesce(F.col("msg.op") == "subscribe", F.lit(False)) | F.coalesce(
        F.col("msg.type") == "COMMAND_RESP", F.lit(False)
    )
    msg = msg.filter(~ack & F.col("msg.topic").startswith("tickers."))
    msg = once(msg, "name", decompose(F.col("msg.data.symbol"), "bybit"))
    data = F.col("msg.data")
    bid, ask = clean_decimal(data["bidPrice"]), clean_decimal(data["askPrice"])
    side_iv = two_sided_mid(clean_decimal(data["bidIv"]), clean_decimal(data["askIv"]))
    reason = F.when(F.col("msg.ts").isNull(), F.lit("timestamp"))
    return _as_ticks(
        msg,
        "bybit",
        reason,
        bid=bid,
        ask=ask,
        mid=two_sided_mid(bid, ask),
        iv=F.coalesce(clean_decimal(data["markPriceIv"]), side_iv),
        underlying=F.coalesce(
            clean_decimal(data["indexPrice"]), clean_decimal(data["underlyingPrice"]), F.lit(NAN)
        ),
        open_interest=F.coalesce(clean_decimal(data["openInterest"]), F.lit(0.0)),
        volume_24h=F.coalesce(clean_decimal(data["volume24h"]), F.lit(0.0)),
        received_at=F.timestamp_millis(F.col("msg.ts")),
    )


DECODERS = {"deribit": decode_deribit, "okx": decode_okx, "bybit": decode_bybit}


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("reject_reason").isNotNull())


def tradable_universe(listing: DataFrame) -> DataFrame:
    """Instruments worth reading, from a listing (venue, name, is_active, status, quote_coin)."""
    deribit = (F.col("venue") == "deribit") & F.col("is_active") & ~F.col("name").contains("_")
    bybit = (F.col("venue") == "bybit") & (F.col("status") == "Trading") & (F.col("quote_coin") == "USDT")
    okx = F.col("venue") == "okx"
    return listing.filter(deribit | bybit | okx).select("venue", "name")


def keep_universe(ticks: DataFrame, universe: DataFrame) -> DataFrame:
    """Ticks (venue, name, ...) whose instrument is in the universe."""
    return ticks.join(universe, ["venue", "name"], "left_semi")

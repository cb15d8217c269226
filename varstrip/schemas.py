"""Fixed schemas of the tables the jobs read and write."""

from __future__ import annotations

TICK = (
    "venue string, asset string, expiry timestamp, strike double, kind string, "
    "bid double, ask double, mid double, iv double, underlying double, "
    "open_interest double, volume_24h double, received_at timestamp"
)
TICK_COLUMNS = [c.split()[0] for c in TICK.split(", ")]

INDEX_TICK = "index_id string, value double, confidence double, strip_hash binary, ts timestamp"

# Historical chain file: numbers arrive as text and are cast with NULL on failure.
HISTORY_CSV_COLUMNS = [
    "timestamp",
    "symbol",
    "type",
    "strike_price",
    "expiration",
    "bid_price",
    "bid_amount",
    "ask_price",
    "ask_amount",
    "mark_price",
    "mark_iv",
    "underlying_price",
]

DERIBIT_FRAME = (
    "method string, error string, params struct<channel string, data struct<"
    "best_bid_price double, best_ask_price double, mark_iv double, underlying_price double, "
    "open_interest double, stats struct<volume double>, timestamp bigint>>"
)
OKX_FRAME = (
    "event string, data array<struct<instType string, instId string, markVol string, "
    "fwdPx string, ts string>>"
)
BYBIT_FRAME = (
    "topic string, ts bigint, type string, op string, data struct<symbol string, "
    "bidPrice string, askPrice string, bidIv string, askIv string, markPrice string, "
    "markPriceIv string, indexPrice string, underlyingPrice string, openInterest string, "
    "volume24h string>"
)
INDEX_MESSAGE = "index_id string, value double, confidence double, strip_hash string, ts string"

"""DuckDB SQL for every registered query whose result plain SQL can recompute."""

from __future__ import annotations

from oracle import ctes as c
from oracle.ctes import with_

ORACLES: dict[str, str] = {}

NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
NOW = "TIMESTAMP '2024-01-30 23:00:00'"
CLOCK = 1_706_745_600

T = (c.EV, c.TICKS)
L = (c.EV, c.BASE, c.LEGS)
CH = (*L, c.CHAINS)
PK = (*CH, c.PICKED)
SPLINE = c.SPLINE.replace("__Y__", "COALESCE(l.call_iv, l.put_iv)")
VAR = (*PK, c.SIDES, SPLINE, c.SEGMENTS, c.VARIANCE)
VEN = (*VAR, c.VENUE_INDEX)
IDX = (c.EV, c.INDEX_TICKS)
BARS = (*IDX, c.BARS)
H5, H60, H1D, H1M = c.history("h5", 5), c.history("h60", 60), c.history("h1d", 1440), c.history("h1m", 1)
HIST = (*L, c.HISTORY)
BASELINE = (*HIST, c.listed_legs("mid", "mid"))
PERP = (c.EV, c.POSITIONS)


def add(name: str, parts, body: str, recursive: bool = False) -> None:
    ORACLES[name] = with_(*parts, recursive=recursive) + body.strip()


# ---------------------------------------------------------------- sources
# Frames are text on the Spark side only; here the expected ticks come from the raw numbers.

NAMED = f"""
named AS (
  SELECT event_id AS seq, k, value, ts, CASE WHEN user_id % 2 = 0 THEN 'btc' ELSE 'eth' END AS asset,
         CAST(date_trunc('day', ts) + INTERVAL 23 DAY + INTERVAL 36 MONTH AS TIMESTAMP) + INTERVAL 8 HOUR AS expiry,
         20e0 + 5e0 * (user_id % 25) AS strike, CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS kind, k % 20 AS defect
  FROM ev)
"""

DERIBIT = """
SELECT seq, 'deribit' AS venue, CASE WHEN defect NOT IN (1, 2) THEN asset WHEN defect = 2 THEN asset END AS asset, expiry, strike, kind,
       CASE WHEN k % 10 <> 9 AND defect <> 3 THEN value * 80e0 END AS bid, CASE WHEN k % 10 <> 8 AND defect <> 3 THEN value * 1.25e0 * 80e0 END AS ask,
       CASE WHEN k % 10 NOT IN (8, 9) AND defect <> 3 THEN (value * 1.25e0 * 80e0 + value * 80e0) * 0.5e0 END AS mid,
       (30e0 + k / 2e0) / 100e0 AS iv, CASE WHEN defect <> 3 THEN 80e0 END AS underlying, CAST(k AS DOUBLE) AS open_interest, value AS volume_24h,
       ts AS received_at,
       CASE defect WHEN 1 THEN 'name_asset' WHEN 2 THEN 'name_part_count' WHEN 3 THEN 'payload' END AS reject_reason
FROM named WHERE defect NOT IN (4, 5)
"""
add("decode_deribit_frames", (c.EV, NAMED), DERIBIT)

OKX = """
SELECT seq, 'okx' AS venue, asset, CASE WHEN defect <> 1 THEN expiry END AS expiry, strike, kind, CAST(NULL AS DOUBLE) AS bid, CAST(NULL AS DOUBLE) AS ask,
       CAST(NULL AS DOUBLE) AS mid, CASE WHEN k % 10 <> 9 THEN 0.3e0 + k / 200e0 END AS iv, CASE WHEN k % 10 <> 8 THEN 75156.25e0 END AS underlying,
       0e0 AS open_interest, 0e0 AS volume_24h, CASE WHEN defect <> 3 THEN ts END AS received_at,
       CASE defect WHEN 1 THEN 'name_expiry' WHEN 2 THEN 'name_quote_currency' WHEN 3 THEN 'timestamp' END AS reject_reason
FROM named WHERE defect <> 4
"""
add("decode_okx_frames", (c.EV, NAMED), OKX)

BYBIT = """
SELECT seq, 'bybit' AS venue, asset, expiry, CASE WHEN defect <> 1 THEN strike END AS strike, kind, CASE WHEN k % 10 <> 9 THEN value END AS bid,
       CASE WHEN k % 10 <> 8 THEN value * 1.25e0 END AS ask, CASE WHEN k % 10 NOT IN (8, 9) THEN (value * 1.25e0 + value) * 0.5e0 END AS mid,
       CASE WHEN k % 4 > 1 THEN 0.3e0 + k / 200e0 WHEN k % 4 = 0 THEN 0.625e0 END AS iv,
       CASE k % 3 WHEN 0 THEN 75007.5e0 WHEN 1 THEN 75006.25e0 END AS underlying, CASE WHEN k % 2 = 0 THEN CAST(k AS DOUBLE) ELSE 0e0 END AS open_interest,
       0e0 AS volume_24h, CASE WHEN defect <> 3 THEN ts END AS received_at,
       CASE defect WHEN 1 THEN 'name_strike' WHEN 2 THEN 'name_quote_currency' WHEN 3 THEN 'timestamp' END AS reject_reason
FROM named WHERE defect <> 4
"""
add("decode_bybit_frames", (c.EV, NAMED), BYBIT)

add(
    "venue_reject_counts",
    (c.EV, NAMED),
    f"""
SELECT venue, reject_reason, count(*) AS n FROM (
  SELECT venue, reject_reason FROM ({DERIBIT}) UNION ALL SELECT venue, reject_reason FROM ({OKX}) UNION ALL SELECT venue, reject_reason FROM ({BYBIT}))
WHERE reject_reason IS NOT NULL GROUP BY ALL
""",
)

add(
    "instrument_names",
    (c.EV, NAMED.replace("k % 20 AS defect", "k % 12 AS defect")),
    """
, x AS (
  SELECT n.*, v.venue, CASE WHEN defect = 10 THEN 'part_count' WHEN defect = 9 AND v.venue <> 'deribit' THEN 'quote_currency'
         WHEN defect IN (1, 2) THEN 'asset' WHEN defect IN (3, 4, 5) THEN 'expiry' WHEN defect IN (6, 7) THEN 'strike' WHEN defect = 8 THEN 'kind' END AS reason
  FROM named n CROSS JOIN (SELECT unnest(['deribit', 'okx', 'bybit']) AS venue) v)
SELECT seq, venue, CASE WHEN reason IS NULL THEN asset END AS asset, CASE WHEN reason IS NULL THEN expiry END AS expiry,
       CASE WHEN reason IS NULL THEN strike END AS strike, CASE WHEN reason IS NULL THEN kind END AS kind, reason FROM x
""",
)

add("decimal_clean", (c.EV,), "SELECT event_id, CASE k % 7 WHEN 4 THEN CAST(CAST(value AS VARCHAR) || 'e1' AS DOUBLE) WHEN 6 THEN value END AS number FROM ev")

add(
    "instrument_universe",
    (c.EV,),
    f"""
SELECT event_id, {c.VENUE} AS venue, 'I' || CASE WHEN user_id % 5 = 0 THEN '_' ELSE '-' END || user_id AS name FROM ev
WHERE ({c.VENUE} = 'okx') OR ({c.VENUE} = 'deribit' AND user_id % 3 <> 0 AND user_id % 5 <> 0) OR ({c.VENUE} = 'bybit' AND user_id % 7 <> 0 AND user_id % 4 <> 0)
""",
)

add(
    "history_csv_clean",
    (c.EV, NAMED),
    """
SELECT seq, ts + to_microseconds(k) AS timestamp,
       upper(asset) || '-' || upper(strftime(expiry, '%-d%b%y')) || '-' || CAST(strike AS INTEGER) || '-' || CASE kind WHEN 'call' THEN 'C' ELSE 'P' END AS symbol,
       upper(asset) AS currency, kind AS type, CASE WHEN k % 9 <> 0 THEN ts + INTERVAL 1 DAY END AS expiration, strike AS strike_price,
       CASE WHEN k % 10 <> 9 THEN value END AS bid_price, CASE WHEN k % 10 <> 7 THEN value END AS bid_amount, CASE WHEN k % 10 <> 8 THEN value END AS ask_price,
       value AS ask_amount, value AS mark_price, CAST(k AS DOUBLE) AS mark_iv, 80.5e0 AS underlying_price
FROM named WHERE defect NOT IN (1, 2)
""",
)

add(
    "benchmark_candles",
    (c.EV, c.BENCHMARK),
    "SELECT asset, timestamp, open, high, low, close FROM candles WHERE timestamp >= TIMESTAMP '2024-01-03' AND timestamp < TIMESTAMP '2024-01-20'",
)
add(
    "candle_gaps",
    (c.EV, c.BENCHMARK),
    """
, g AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY asset ORDER BY timestamp))) / 1e6 AS gap FROM candles)
SELECT asset, count(*) AS rows, max(gap) AS max_gap_s, count(*) FILTER (WHERE gap > 5400) AS gaps, min(close) AS close_min, max(close) AS close_max,
       COALESCE(max(gap) > 86400, FALSE) AS warn_gap, min(close) < 1 OR max(close) > 500 AS warn_range
FROM g GROUP BY asset
""",
)
add(
    "tick_retention",
    T,
    "SELECT venue, asset, count(*) AS kept, min(ts) AS oldest FROM ticks WHERE CAST(ts AS DATE) + INTERVAL 1 YEAR > DATE '2025-01-15' GROUP BY ALL",
)
RFC = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
add(
    "tick_messages",
    T,
    f"""
SELECT seq, 'options:' || venue || ':' || asset AS topic, {RFC.format('expiry')} AS expiry, {RFC.format('received_at')} AS received_at,
       {RFC.format('received_at')} AS ts, kind, bid, mid, bid IS NULL AS bid_null FROM ticks
""",
)
add(
    "index_messages",
    IDX,
    f"""
SELECT 'index:' || index_id || ':stream' AS key, count(*) AS n, CAST(NULL AS VARCHAR) AS ts, CAST(NULL AS VARCHAR) AS strip_hash FROM index_ticks GROUP BY index_id
UNION ALL
SELECT 'index:' || index_id || ':latest', 1, {RFC.format('last(ts ORDER BY ts, seq)')}, last(strip_hash_hex ORDER BY ts, seq) FROM index_ticks GROUP BY index_id
""",
)
add(
    "client_ticks",
    IDX,
    f"""
SELECT seq, 'tick' AS type, lower(index_id) AS channel, value, CASE WHEN seq % 50 = 10 THEN epoch_ms({NOW}) ELSE epoch_ms(ts) END AS ts_ms, confidence
FROM index_ticks WHERE seq % 50 NOT IN (7, 8, 9)
""",
)
add(
    "index_domain_split",
    IDX,
    "SELECT seq, CASE WHEN seq % 11 IN (1, 2) THEN 'value' WHEN seq % 11 = 3 THEN 'confidence' WHEN seq % 11 = 4 THEN 'strip_hash' ELSE 'valid' END AS reason FROM index_ticks",
)
add(
    "strip_domain_split",
    L,
    """
SELECT snapshot_ts, venue, asset, expiry,
       CASE WHEN count(*) < 5 THEN 'too_few_quotes' WHEN min(least(call_mid, put_mid)) < 0 THEN 'q'
            WHEN max(CASE WHEN strike = 40 THEN COALESCE(call_iv, 9e0) * 6e0 ELSE put_iv END) > 5 THEN 'iv' END AS reason
FROM legs WHERE put_mid IS NOT NULL GROUP BY ALL
""",
)

# ---------------------------------------------------------------- quality
F = (*T, c.FLAGS)
add("tick_rule_flags", F, "SELECT seq, arrival_ts, NOT (age BETWEEN 0 AND 5) AS stale, crossed, wide, below FROM flags")
add("tick_drop_reasons", F, "SELECT drop_reason, count(*) AS ticks FROM classified GROUP BY ALL")
_tuned = c.FLAGS.replace("BETWEEN 0 AND 5", "BETWEEN 0 AND 3").replace("> 0.30e0", "> 0.1e0").replace("mid + 0.01e0", "mid + 2.5e0")
add("tuned_drop_reasons", (*T, _tuned), "SELECT drop_reason, count(*) AS ticks FROM classified GROUP BY ALL")
add("clean_ticks", F, "SELECT seq, venue, asset, expiry, strike, kind, bid, ask, mid, iv, received_at, arrival_ts FROM classified WHERE drop_reason = 'pass'")
add(
    "tick_dedup",
    T,
    """
SELECT min_by(seq, (arrival_ts, seq)) AS seq, venue, asset, strike, kind, min_by(bid, (arrival_ts, seq)) AS bid, received_at, min(arrival_ts) AS arrival_ts
FROM (SELECT * REPLACE (COALESCE(bid, -1) AS bid) FROM ticks) GROUP BY venue, asset, expiry, strike, kind, received_at
""".replace("min_by(bid, (arrival_ts, seq)) AS bid", "nullif(min_by(bid, (arrival_ts, seq)), -1) AS bid"),
)
add(
    "quality_counters",
    F,
    """
SELECT 'received' AS counter, venue || '/' || asset AS label, count(*) AS n FROM ticks GROUP BY ALL
UNION ALL SELECT 'filtered', drop_reason, count(*) FROM classified WHERE drop_reason <> 'pass' GROUP BY ALL
UNION ALL SELECT 'deduped', venue, CAST(sum(extra) AS BIGINT) FROM (
  SELECT venue, count(*) - 1 AS extra FROM classified WHERE drop_reason = 'pass' GROUP BY venue, asset, expiry, strike, kind, received_at) GROUP BY venue
""",
)
SNAP = "CASE WHEN ts = time_bucket(INTERVAL 60 SECOND, ts) THEN ts ELSE time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND END"
add(
    "snapshot_freshness",
    T,
    f"""
, s AS (SELECT *, {SNAP} AS snapshot_ts FROM ticks)
SELECT snapshot_ts, venue, count(*) AS ticks, max(ts) AS newest FROM s WHERE snapshot_ts - ts <= INTERVAL 30 SECOND GROUP BY ALL
""",
)
add(
    "snapshot_overlap",
    T,
    """
, h AS (SELECT *, unnest([0, 1, 2, 3]) AS ahead, CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS f FROM ticks),
s AS (SELECT *, f + to_hours(ahead) AS snapshot_ts FROM h)
SELECT snapshot_ts, venue, count(*) AS ticks, min(ts) AS oldest FROM s WHERE snapshot_ts - ts <= INTERVAL 3 HOUR GROUP BY ALL
""",
)
ODD = """
odd AS (
  SELECT * REPLACE (
    CASE WHEN seq % 13 = 0 THEN 'Deribit' ELSE venue END AS venue, CASE WHEN seq % 17 = 0 THEN 'straddle' ELSE kind END AS kind,
    CASE WHEN seq % 19 = 0 THEN NULL WHEN seq % 23 = 0 THEN -strike ELSE strike END AS strike, CASE WHEN seq % 29 = 0 THEN NULL ELSE iv END AS iv)
  FROM ticks),
valid AS (SELECT * FROM odd WHERE venue IN ('bybit', 'deribit', 'okx') AND kind IN ('call', 'put') AND strike > 0)
"""
add("chain_row_validity", (*T, ODD), "SELECT seq, arrival_ts, venue, kind, strike, mid, iv FROM valid")
add(
    "finite_guard",
    (*T, ODD),
    "SELECT strike IS NOT NULL AS strike_finite, iv IS NOT NULL AS iv_finite, mid IS NOT NULL AS mid_finite, count(*) AS n FROM odd GROUP BY ALL",
)

# ---------------------------------------------------------------- chains
DAILY = (*T, ODD.replace("CASE WHEN seq % 29 = 0 THEN NULL ELSE iv END", "CASE WHEN seq % 29 = 0 THEN 'inf'::DOUBLE ELSE iv END"), """
daily AS (SELECT *, CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS snapshot_ts FROM valid)
""")


def latest(col: str, extra: str = "TRUE") -> str:
    return f"last({col} ORDER BY ts, seq) FILTER (WHERE {col} IS NOT NULL AND {extra})"


add(
    "latest_quotes",
    DAILY,
    "SELECT snapshot_ts, venue, asset, expiry, strike, kind, " + ", ".join(f"{latest(x)} AS {x}" for x in ("bid", "ask", "mid", "iv"))
    + ", max(ts) AS latest_ts FROM daily GROUP BY snapshot_ts, venue, asset, expiry, strike, kind",
)
add(
    "latest_legs",
    DAILY,
    "SELECT snapshot_ts, venue, asset, expiry, strike, "
    + ", ".join(f"CASE WHEN isfinite({latest(x, f'''kind = '{k}' ''')}) THEN {latest(x, f'''kind = '{k}' ''')} END AS {k}_{x}" for x in ("mid", "iv") for k in ("call", "put"))
    + ", max(ts) AS latest_ts FROM daily GROUP BY snapshot_ts, venue, asset, expiry, strike",
)
add("venue_freshness", DAILY, "SELECT snapshot_ts, venue, max(ts) AS latest_ts FROM daily GROUP BY ALL")
add(
    "fold_legs",
    L,
    "SELECT snapshot_ts, venue, asset, expiry, count(*) AS legs, "
    + ", ".join(f"count({x}) AS {x}_n, round(sum({x}), 6) AS {x}" for x in ("call_mid", "put_mid", "call_iv", "put_iv"))
    + " FROM legs GROUP BY ALL",
)
add(
    "chain_assembly",
    L,
    """
, k AS (SELECT *, COALESCE(call_iv, put_iv) AS iv, row_number() OVER (PARTITION BY snapshot_ts, venue, asset, expiry ORDER BY strike) - 1 AS pos
        FROM legs WHERE COALESCE(call_iv, put_iv) IS NOT NULL)
SELECT snapshot_ts, venue, asset, expiry, count(*) AS knots, min(strike) AS first, max(strike) AS last, sum(pos * strike) AS weighted, round(sum(iv), 6) AS iv_sum
FROM k GROUP BY ALL
""",
)
add(
    "chain_forwards",
    CH,
    "SELECT snapshot_ts, venue, asset, expiry, CAST(listed_strikes AS INTEGER) AS listed_strikes, parity_strike, round(forward, 6) AS forward, round(t, 9) AS t, strip_status FROM chains",
)
add(
    "usable_iv",
    L,
    """
, o AS (SELECT *, CASE WHEN strike % 12 <> 0 AND call_iv IS NOT NULL THEN call_iv WHEN strike % 24 <> 0 THEN put_iv END AS u FROM legs)
SELECT snapshot_ts, venue, asset, expiry, count(u) AS usable, round(max(u), 6) AS max_iv FROM o GROUP BY ALL
""",
)
add("strict_legs", L, "SELECT snapshot_ts, venue, asset, expiry, count(*) AS legs FROM legs WHERE call_mid IS NOT NULL AND put_mid IS NOT NULL AND COALESCE(call_iv, put_iv) > 1e-3 GROUP BY ALL")
add("minimum_strip", CH, "SELECT snapshot_ts, venue, asset, count(*) AS expiries FROM chains WHERE listed_strikes >= 5 GROUP BY ALL")
add(
    "year_fractions",
    T,
    "SELECT seq, arrival_ts, (epoch_us(expiry) - epoch_us(ts)) / 1e6 / 31536000e0 AS years, (epoch_us(expiry) - epoch_us(ts)) / 1e6 / 31536000e0 * 525600e0 AS minutes FROM ticks",
)
add("log_moneyness", T, "SELECT seq, arrival_ts, round(ln(strike / 80e0), 9) AS x FROM ticks")
add("expiry_picker", PK, "SELECT snapshot_ts, venue, asset, bracket_status, near_expiry, next_expiry FROM bracket")
add("expiry_picker_earliest", PK, "SELECT snapshot_ts, venue, asset, bracket_status, near_expiry_min AS near_expiry, next_expiry FROM bracket")

# ---------------------------------------------------------------- numerics
add("normal_cdf", (c.EV,), f", x AS (SELECT event_id, (value - 50e0) / 20e0 AS z FROM ev) SELECT event_id, round({c.ncdf('z')}, 10) AS cdf FROM x")
add(
    "option_prices",
    T,
    f"""
, a AS (SELECT seq, arrival_ts, strike AS k, CASE WHEN seq % 10 = 1 THEN -1e0 ELSE 80e0 END AS f, CASE WHEN seq % 10 = 2 THEN 0e0 ELSE iv END AS v,
               CASE WHEN seq % 10 = 3 THEN 0e0 ELSE (epoch_us(expiry) - epoch_us(ts)) / 1e6 / 31536000e0 END AS t FROM ticks),
d AS (SELECT *, CASE WHEN f > 0 AND v > 0 AND t > 0 THEN (ln(f / k) + 0.5e0 * v * v * t) / (v * sqrt(t)) END AS d1 FROM a WHERE seq % 10 <> 1),
e AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM d)
SELECT seq, arrival_ts,
       round(CASE WHEN d1 IS NULL THEN greatest(f - k, 0e0) ELSE f * {c.ncdf('d1')} - k * {c.ncdf('d2')} END * exp(-0.05e0 * t), 6) AS call,
       round(CASE WHEN d1 IS NULL THEN greatest(k - f, 0e0) ELSE k * {c.ncdf('(-d2)')} - f * {c.ncdf('(-d1)')} END * exp(-0.05e0 * t), 6) AS put
FROM e
UNION ALL SELECT seq, arrival_ts, 0e0, 0e0 FROM a WHERE seq % 10 = 1
""",
)
add(
    "spline_curvature",
    (*PK, c.SIDES, SPLINE),
    """
SELECT s.snapshot_ts, s.venue, s.asset, s.side, count(*) AS knots, round(sum(abs(m)), 4) AS total, round(sum(m * (i - 1)), 3) AS weighted,
       round(arg_max(m, i), 6) AS last
FROM curv JOIN sides s USING (cid) GROUP BY ALL
""",
    True,
)
GRID = (*PK, c.SIDES, SPLINE, c.SEGMENTS)
add(
    "strip_points",
    GRID,
    """
SELECT s.snapshot_ts, s.venue, s.asset, s.side, count(*) AS points, CAST(sum(j) AS BIGINT) AS j_sum, round(min(strike), 6) AS k_min, round(max(strike), 6) AS k_max,
       round(sum(q), 4) AS q_sum, round(sum(iv), 4) AS iv_sum, round(max(q), 6) AS q_max, round(max(CASE WHEN j = j0 THEN strike END), 6) AS k_zero
FROM pts JOIN sides s USING (cid) GROUP BY ALL
""",
    True,
)
add(
    "iv_clamp",
    (*PK, c.SIDES, c.SPLINE.replace("__Y__", "(COALESCE(l.call_iv, l.put_iv) - 0.5e0) * 20e0"), c.SEGMENTS),
    """
SELECT s.snapshot_ts, s.venue, s.asset, s.side, count(*) FILTER (WHERE iv = 1e-4) AS at_floor, count(*) FILTER (WHERE iv = 5e0) AS at_cap
FROM pts JOIN sides s USING (cid) GROUP BY ALL
""",
    True,
)
add(
    "expiry_variance",
    VAR,
    """
SELECT b.snapshot_ts, b.venue, b.asset, b.side, CAST(v.listed_strikes AS INTEGER) AS listed_strikes, COALESCE(v.strip_status, 'non_positive_t') AS strip_status,
       CASE WHEN v.strip_status = 'ok' THEN CASE WHEN sigma_sq < 0 THEN 'negative' ELSE 'ok' END END AS variance_status,
       round(v.forward, 6) AS forward, round(v.k_zero, 6) AS k_zero, round(v.integral, 6) AS integral, round(v.sigma_sq, 6) AS sigma_sq
FROM sides0 b LEFT JOIN variances v USING (snapshot_ts, venue, asset, side)
""",
    True,
)
add(
    "interpolation_cases",
    (c.EV,),
    """
, a AS (SELECT event_id, k * 600e0 - 1200e0 AS n1, k * 600e0 - 1200e0 + (user_id % 60) * 1000e0 - 2000e0 AS n2, value / 200e0 - 0.01e0 AS s1, k / 150e0 AS s2 FROM ev),
t AS (SELECT *, CASE WHEN n1 <> n2 THEN (n1 / 525600e0 * s1 * ((n2 - 43200e0) / (n2 - n1)) + n2 / 525600e0 * s2 * ((43200e0 - n1) / (n2 - n1))) * (525600e0 / 43200e0) END AS total FROM a),
s AS (SELECT *, CASE WHEN n1 <= 0 THEN 'near_minutes' WHEN n2 <= 0 THEN 'next_minutes' WHEN n1 >= n2 THEN 'inverted_bracket' WHEN s1 < 0 THEN 'near_variance'
                     WHEN s2 < 0 THEN 'next_variance' WHEN total < 0 THEN 'negative' ELSE 'ok' END AS status FROM t)
SELECT event_id, status, CASE WHEN status = 'ok' THEN round(total, 6) END AS sigma_sq_30d, CASE WHEN status = 'ok' THEN round(100e0 * sqrt(greatest(total, 0e0)), 4) END AS value FROM s
""",
)
add(
    "smile_points",
    GRID,
    """
, n AS (SELECT venue, asset, max(snapshot_ts) AS snapshot_ts FROM sides WHERE side = 'near' AND strip_status = 'ok' GROUP BY ALL)
SELECT s.venue, s.asset, s.snapshot_ts, p.j AS pos, round(p.forward, 6) AS forward, round(p.strike, 6) AS strike, round(p.iv * 100e0, 5) AS iv_pct
FROM n JOIN sides s USING (venue, asset, snapshot_ts) JOIN pts p USING (cid) WHERE s.side = 'near'
""".replace("p.j AS pos", "CAST(p.j AS INTEGER) AS pos"),
    True,
)
add(
    "listed_vs_vanilla",
    (*BASELINE, c.listed_variance("v", "mid")),
    f"""
, w AS (SELECT * FROM v_k WHERE k_zero IS NOT NULL AND strike > 0.5e0 * spot AND strike < 2e0 * spot),
u AS (SELECT snapshot_ts, venue, asset, expiry, strike, t, forward AS f, 'call' AS kind, call AS quote_usd, call_iv AS iv FROM w
      UNION ALL SELECT snapshot_ts, venue, asset, expiry, strike, t, forward, 'put', put, put_iv FROM w),
d AS (SELECT *, CASE WHEN iv > 0 THEN (ln(f / strike) + 0.5e0 * iv * iv * t) / (iv * sqrt(t)) END AS d1 FROM u),
e AS (SELECT *, d1 - iv * sqrt(t) AS d2 FROM d),
m AS (SELECT *, CASE WHEN kind = 'call' THEN CASE WHEN d1 IS NULL THEN greatest(f - strike, 0e0) ELSE f * {c.ncdf('d1')} - strike * {c.ncdf('d2')} END
                     ELSE CASE WHEN d1 IS NULL THEN greatest(strike - f, 0e0) ELSE strike * {c.ncdf('(-d2)')} - f * {c.ncdf('(-d1)')} END END AS model_usd FROM e)
SELECT snapshot_ts, venue, asset, expiry, kind, count(*) AS strikes, round(sum(quote_usd), 6) AS quote_usd, round(sum(model_usd), 6) AS model_usd,
       round(max(quote_usd), 6) AS quote_max, round(max(model_usd), 6) AS model_max
FROM m GROUP BY ALL
""",
)

# ---------------------------------------------------------------- cross-venue
add(
    "venue_index",
    VEN,
    "SELECT snapshot_ts, venue, asset, status, round(value, 6) AS value, CAST(near_listed_strikes AS INTEGER) AS near_listed_strikes, CAST(next_listed_strikes AS INTEGER) AS next_listed_strikes, latest_ts FROM venue_index",
    True,
)
add("venue_rejections", VEN, "SELECT venue, status, count(*) AS n FROM venue_rows GROUP BY ALL", True)
add(
    "near_next_join",
    (*PK, c.SIDES),
    """
SELECT b.snapshot_ts, b.venue, b.asset, b.bracket_status, round(n.t, 9) AS near_t, round(x.t, 9) AS next_t,
       COALESCE(n.strip_status, 'non_positive_t') AS near_strip_status, COALESCE(x.strip_status, 'non_positive_t') AS next_strip_status
FROM bracket b LEFT JOIN chains n ON (n.snapshot_ts, n.venue, n.asset, n.expiry) = (b.snapshot_ts, b.venue, b.asset, b.near_expiry)
LEFT JOIN chains x ON (x.snapshot_ts, x.venue, x.asset, x.expiry) = (b.snapshot_ts, b.venue, b.asset, b.next_expiry)
""",
)

LEVELS = """
vals AS (SELECT CASE asset WHEN 'btc' THEN 'BTCV30' ELSE 'ETHV30' END AS index_id, snapshot_ts, venue, 100e0 * iv0 AS value FROM levels)
"""


def tracker(threshold: float, limit: int, source: str = "vals") -> str:
    """The outlier policy as a literal tick-by-tick state machine over pivoted venues."""
    vs = ("bybit", "deribit", "okx")
    piv = ", ".join(f"max(value) FILTER (WHERE venue = '{v}') AS v_{v[0]}" for v in vs)
    ev = "(n >= 2 AND med IS NOT NULL AND abs(med) >= 2.220446049250313e-16)"
    out = "; ".join("")

    def oob(v):
        return f"COALESCE({ev} AND abs((v_{v} - med) / med) > {threshold}e0, FALSE)"

    def inb(v):
        return f"({ev} AND v_{v} IS NOT NULL AND NOT o_{v})"

    f = "bdo"
    streak = ", ".join(f"CASE WHEN k.o_{v} THEN s.k_{v} + 1 WHEN k.i_{v} THEN 0 ELSE s.k_{v} END AS k_{v}" for v in f)
    lim = {v: f"(k.o_{v} AND s.k_{v} + 1 >= {limit})" for v in f}
    stays = "(" + " OR ".join(f"(k.v_{v} IS NOT NULL AND NOT {lim[v]})" for v in f) + ")"
    drop = ", ".join(f"CASE WHEN {lim[v]} AND {stays} THEN TRUE WHEN k.i_{v} THEN FALSE ELSE s.d_{v} END AS d_{v}" for v in f)
    was = ", ".join(f"s.d_{v} AS w_{v}" for v in f)
    lims = ", ".join(f"{lim[v]} AS l_{v}" for v in f)
    return f"""
piv AS (SELECT index_id, snapshot_ts, {piv}, count(*) AS n, median(value) AS med, row_number() OVER (PARTITION BY index_id ORDER BY snapshot_ts) AS rn
        FROM {source} GROUP BY index_id, snapshot_ts),
band AS (SELECT *, {", ".join(f"{oob(v)} AS o_{v}" for v in f)}, {ev} AS evaluable FROM piv),
tick AS MATERIALIZED (SELECT *, {", ".join(f"{inb(v)} AS i_{v}" for v in f)} FROM band),
state AS (
  SELECT index_id, CAST(0 AS BIGINT) AS rn, {", ".join(f"0 AS k_{v}" for v in f)}, {", ".join(f"FALSE AS d_{v}" for v in f)},
         {", ".join(f"FALSE AS w_{v}" for v in f)}, {", ".join(f"FALSE AS l_{v}" for v in f)}, TRUE AS stays
  FROM (SELECT DISTINCT index_id FROM piv)
  UNION ALL
  SELECT k.index_id, k.rn, {streak}, {drop}, {was}, {lims}, {stays} AS stays
  FROM state s JOIN tick k ON k.index_id = s.index_id AND k.rn = s.rn + 1),
long AS (
  """ + " UNION ALL ".join(
        f"SELECT t.index_id, t.snapshot_ts, '{v}' AS venue, t.v_{v[0]} AS value, t.n, t.med AS median, t.evaluable, t.o_{v[0]} AS out_of_band, s.k_{v[0]} AS streak, "
        f"s.d_{v[0]} AS dropped, s.w_{v[0]} AS was, s.l_{v[0]} AS at_limit, s.stays FROM tick t JOIN state s USING (index_id, rn) WHERE t.v_{v[0]} IS NOT NULL"
        for v in vs
    ) + """),
kept AS (SELECT *, CASE WHEN n < 2 THEN TRUE WHEN NOT evaluable THEN NOT dropped ELSE NOT at_limit OR (NOT stays AND NOT was) END AS keep FROM long),
verdict AS (SELECT *, dropped AND NOT was AS newly_dropped, was AND NOT dropped AS newly_restored,
                   keep OR NOT bool_or(keep) OVER (PARTITION BY index_id, snapshot_ts) AS active FROM kept)
"""


OUT = (c.EV, c.BASE, LEVELS, tracker(0.05, 5))
add("index_dimension_join", (c.EV, c.BASE, LEVELS), "SELECT index_id, venue, count(*) AS n, max(value) AS highest FROM vals GROUP BY ALL")
add(
    "deviation_streaks",
    OUT,
    "SELECT index_id, snapshot_ts, venue, CAST(n AS INTEGER) AS venues, median, CASE WHEN evaluable THEN round(abs((value - median) / median), 9) END AS deviation, out_of_band, CAST(streak AS BIGINT) AS streak FROM verdict",
    True,
)
add(
    "outlier_state",
    OUT,
    "SELECT index_id, snapshot_ts, venue, CAST(streak AS BIGINT) AS streak, dropped, newly_dropped, newly_restored, active FROM verdict",
    True,
)
add(
    "outlier_transitions",
    (c.EV, c.BASE, LEVELS, tracker(0.02, 3)),
    """
SELECT index_id, snapshot_ts, venue, CASE WHEN newly_dropped THEN 'dropped' ELSE 'restored' END AS transition, value, median,
       CASE WHEN evaluable THEN round(abs((value - median) / median), 9) END AS deviation, CAST(streak AS BIGINT) AS streak
FROM verdict WHERE newly_dropped OR newly_restored
""",
    True,
)
add(
    "outlier_counters",
    (c.EV, c.BASE, LEVELS, tracker(0.02, 3)),
    """
, live AS (SELECT index_id, snapshot_ts, count(*) FILTER (WHERE active) AS n FROM verdict GROUP BY ALL)
SELECT index_id, 'outlier_dropped' AS counter, venue AS label, count(*) AS n FROM verdict WHERE newly_dropped GROUP BY ALL
UNION ALL SELECT index_id, 'outlier_restored', venue, count(*) FROM verdict WHERE newly_restored GROUP BY ALL
UNION ALL SELECT index_id, 'active_venues', 'newest', arg_max(n, snapshot_ts) FROM live GROUP BY index_id
""",
    True,
)
add("active_and_dropped", OUT, "SELECT index_id, snapshot_ts, venue, value, active FROM verdict", True)
add(
    "median_blend",
    OUT,
    "SELECT index_id, snapshot_ts, median(value) AS value, count(*) AS venues_live, min(venue) AS primary_venue FROM verdict WHERE active GROUP BY ALL",
    True,
)


def score(live: str, age: str, strikes: str) -> str:
    return f"least(greatest({live} / 3e0, 0e0), 1e0) * least(greatest(1e0 - greatest({age}, 0e0) / 60e0, 0e0), 1e0) * least(greatest({strikes} / 8e0, 0e0), 1e0)"


add(
    "confidence_cases",
    (c.EV,),
    f"SELECT event_id, round({score('(user_id % 5)', '(value - 5e0)', '(k % 12)')}, 9) AS confidence, round(least(greatest(1e0 - greatest(value - 5e0, 0e0) / 60e0, 0e0), 1e0), 9) AS confidence_unset FROM ev",
)
VALS = """
vals AS (SELECT CASE asset WHEN 'btc' THEN 'BTCV30' ELSE 'ETHV30' END AS index_id, snapshot_ts, venue, value FROM venue_index WHERE status = 'ok')
"""
BLEND = (*VEN, VALS, tracker(0.05, 5), f"""
blended AS (
  SELECT v.index_id, v.snapshot_ts, median(v.value) AS value, count(*) AS venues_live, min(v.venue) AS primary_venue,
         max((epoch_us(v.snapshot_ts) - epoch_us(i.latest_ts)) / 1e6) AS age, min(least(i.near_listed_strikes, i.next_listed_strikes)) AS strikes
  FROM verdict v JOIN venue_index i ON i.snapshot_ts = v.snapshot_ts AND i.venue = v.venue AND CASE i.asset WHEN 'btc' THEN 'BTCV30' ELSE 'ETHV30' END = v.index_id
  WHERE v.active GROUP BY ALL)
""")
add(
    "blended_index",
    BLEND,
    f"SELECT index_id, snapshot_ts, round(value, 6) AS value, round({score('venues_live', 'age', 'strikes')}, 6) AS confidence, venues_live, CAST(strikes AS INTEGER) AS strip_strikes, primary_venue FROM blended",
    True,
)
add(
    "published_rows",
    BLEND,
    """
, ends AS (SELECT min(snapshot_ts) AS low, max(snapshot_ts) AS high FROM venue_index),
seen AS (SELECT unnest(generate_series(low, high, INTERVAL 1 HOUR)) AS snapshot_ts FROM ends),
any_quote AS (SELECT DISTINCT snapshot_ts FROM venue_index),
have AS (SELECT DISTINCT snapshot_ts, CASE asset WHEN 'btc' THEN 'BTCV30' ELSE 'ETHV30' END AS index_id FROM venue_index)
SELECT i.index_id, s.snapshot_ts, CASE WHEN b.value IS NOT NULL THEN 'ok' WHEN q.snapshot_ts IS NULL THEN 'no_quotes' WHEN h.index_id IS NOT NULL THEN 'no_venues_live' ELSE 'missing_asset' END AS status, round(b.value, 6) AS value
FROM seen s CROSS JOIN (SELECT unnest(['BTCV30', 'ETHV30']) AS index_id) i
LEFT JOIN blended b ON (b.snapshot_ts, b.index_id) = (s.snapshot_ts, i.index_id) LEFT JOIN have h ON (h.snapshot_ts, h.index_id) = (s.snapshot_ts, i.index_id) LEFT JOIN any_quote q ON q.snapshot_ts = s.snapshot_ts
""",
    True,
)

# ---------------------------------------------------------------- series
BAR = "SELECT index_id, bucket, open, high, low, close, count, round(avg_confidence, 9) AS avg_confidence FROM bars"
add("minute_bars", BARS, BAR)
add("merged_bars", BARS, BAR)
for _n, _h, _name in (("h5", H5, "history_5m"), ("h60", H60, "history_1h"), ("h1d", H1D, "history_1d")):
    add(_name, (*BARS, _h), f"SELECT index_id, ts, open, high, low, close, count, round(avg_confidence, 9) AS avg_confidence FROM {_n}")
add("newest_bars", (*BARS, H60), "SELECT index_id, ts, open, high, low, close, count FROM h60 WHERE index_id = 'BTCV30' ORDER BY ts DESC LIMIT 100")
add(
    "timeframe_presets",
    (*BARS, H1M, H5, H60, H1D),
    " UNION ALL ".join(
        f"SELECT '{n}' AS timeframe, index_id, ts, open, close, count FROM {h} QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY ts DESC) <= {lim}"
        for n, h, lim in (("1h", "h1m", 60), ("1d", "h5", 288), ("7d", "h60", 168), ("30d", "h60", 720), ("90d", "h1d", 90), ("all", "h1d", 5000))
    ),
)
NEWEST = "newest AS (SELECT * FROM index_ticks QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY ts DESC, seq DESC) = 1)"
add("latest_value", (*IDX, NEWEST), "SELECT index_id, value, confidence, strip_hash_hex, ts, seq FROM newest")
add(
    "latest_view",
    (*IDX, NEWEST),
    f"""
SELECT index_id, value, {RFC.format('ts')} AS ts, confidence, '0x' || strip_hash_hex AS source_strip_hash,
       CAST(greatest(0, least(60, 60 - trunc(epoch(TIMESTAMP '2024-01-31' - ts)))) AS BIGINT) AS next_update_eta_seconds FROM newest
""",
)
add(
    "update_eta",
    T,
    "SELECT seq, arrival_ts, CAST(greatest(0, least(60, 60 - trunc((epoch_us(arrival_ts) - epoch_us(received_at)) / 1e6 * 15 - 5))) AS BIGINT) AS eta FROM ticks",
)
add(
    "series_stats",
    (*BARS, H60),
    """
, s AS (SELECT index_id, arg_min(open, ts) AS open, arg_max(close, ts) AS close, max(high) AS high, min(low) AS low, CAST(sum(count) AS BIGINT) AS total_ticks,
               sum(CASE WHEN avg_confidence > 0 THEN avg_confidence * count END) / sum(CASE WHEN avg_confidence > 0 THEN count END) AS ac FROM h60 GROUP BY index_id)
SELECT index_id, open, close, high, low, total_ticks, round(CASE WHEN open = 0 THEN 0 ELSE (close - open) / open * 100e0 END, 6) AS change_pct, round(COALESCE(ac, 0), 6) AS avg_confidence FROM s
""",
)
add("bar_moves", (*BARS, H60), "SELECT index_id, ts, CASE WHEN open <> 0 THEN round((close - open) / open * 100e0, 4) END AS change_pct, high - low AS range FROM h60")
add(
    "first_to_last",
    (*BARS, H60),
    """
, s AS (SELECT index_id, arg_min(close, ts) AS first, arg_max(close, ts) AS last FROM h60 GROUP BY index_id)
SELECT index_id, first, last, last - first AS delta, round((last - first) / first * 100e0, 6) AS delta_pct, CASE WHEN last - first >= 0 THEN 'up' ELSE 'down' END AS tone FROM s
""",
)
add(
    "tick_direction",
    IDX,
    """
, p AS (SELECT index_id, seq, value, lag(value) OVER (PARTITION BY index_id ORDER BY ts, seq) AS previous_value FROM index_ticks)
SELECT *, CASE WHEN value > previous_value THEN 'up' WHEN value < previous_value THEN 'down' END AS direction FROM p
""",
)
add(
    "ema_overlay",
    (*BARS, H60, """
s AS (SELECT index_id, ts, close FROM h60 QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY ts DESC) <= 168),
n AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY ts) AS i, least(20, greatest(4, count(*) OVER (PARTITION BY index_id) // 6)) AS period FROM s),
e AS (
  SELECT index_id, max(i) AS i, any_value(period) AS period, avg(close) AS ema FROM n WHERE i <= period GROUP BY index_id HAVING max(i) = any_value(period)
  UNION ALL
  SELECT n.index_id, n.i, n.period, n.close * (2e0 / (n.period + 1)) + e.ema * (1 - 2e0 / (n.period + 1)) FROM e JOIN n ON n.index_id = e.index_id AND n.i = e.i + 1)
"""),
    "SELECT n.index_id, n.ts, n.close, CAST(n.period AS INTEGER) AS period, round(e.ema, 6) AS ema FROM n LEFT JOIN e USING (index_id, i)",
    True,
)
add(
    "live_bar",
    (c.EV, c.INDEX_TICKS.replace("index_ticks AS", "all_ticks AS"), "index_ticks AS (SELECT * FROM all_ticks WHERE ts < TIMESTAMP '2024-01-30 12:00:00')", c.BARS, H1D),
    """
, b AS (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY ts DESC) AS rk FROM h1d QUALIFY rk <= 30),
t AS (SELECT index_id, value AS v, ts AS tts FROM all_ticks QUALIFY row_number() OVER (PARTITION BY index_id ORDER BY ts DESC, seq DESC) = 1)
SELECT b.index_id, b.ts, b.open, CASE WHEN rk = 1 AND tts >= b.ts THEN greatest(high, v) ELSE high END AS high, CASE WHEN rk = 1 AND tts >= b.ts THEN least(low, v) ELSE low END AS low,
       CASE WHEN rk = 1 AND tts >= b.ts THEN v ELSE close END AS close, count FROM b JOIN t USING (index_id)
""",
)
add(
    "freshness_report",
    IDX,
    "SELECT count(*) AS rows, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(max(ts)) / 1e6 AS age_s, 'degraded' AS status FROM index_ticks".replace(
        "epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(max(ts)) / 1e6", "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 1e6"
    ).replace("'degraded'", "CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 90000000 THEN 'degraded' ELSE 'ok' END"),
)
add(
    "pipeline_checks",
    (*T, c.INDEX_TICKS),
    f"""
, i AS (SELECT * FROM index_ticks WHERE ts <= {NOW}),
x AS (
  SELECT 'option_ticks_last_minute' AS "check", CAST(count(*) AS DOUBLE) AS observed FROM ticks WHERE ts <= {NOW} AND ts > {NOW} - INTERVAL 60 SECOND
  UNION ALL SELECT 'index_ticks_last_two_minutes', count(*) FROM i WHERE ts > {NOW} - INTERVAL 120 SECOND
  UNION ALL SELECT 'index_distinct_times', count(DISTINCT ts) FROM i
  UNION ALL SELECT 'index_latest_value', arg_max(value, ts) FROM i
  UNION ALL SELECT 'history_bars', count(DISTINCT date_trunc('minute', ts)) FROM i
  UNION ALL SELECT 'live_ticks_BTCV30', count(*) FROM i WHERE index_id = 'BTCV30' AND ts > {NOW} - INTERVAL 75 SECOND
  UNION ALL SELECT 'live_ticks_ETHV30', count(*) FROM i WHERE index_id = 'ETHV30' AND ts > {NOW} - INTERVAL 75 SECOND)
SELECT "check", observed, CASE "check" WHEN 'index_latest_value' THEN observed > 0 WHEN 'index_distinct_times' THEN observed >= 2 ELSE observed >= 1 END AS passed FROM x
""",
)
add(
    "index_allow_list",
    (c.EV,),
    "SELECT event_id, CASE k % 4 WHEN 0 THEN 'btcv30' WHEN 1 THEN 'EthV30' ELSE 'BTCV30' END AS requested, CASE k % 4 WHEN 1 THEN 'ETHV30' ELSE 'BTCV30' END AS index_id FROM ev WHERE k % 4 < 3",
)
add(
    "fixed_point_quotes",
    IDX,
    """
, s AS (SELECT seq, CAST(floor(value / 7e0 * 1e8 + 0.5e0) AS BIGINT) AS v, CASE seq % 9 WHEN 0 THEN 0e0 WHEN 1 THEN 1.7e0 ELSE confidence END AS cf FROM index_ticks)
SELECT seq, v AS value_scaled, CAST(greatest(0, least(1000000, floor(cf * 1e6 + 0.5e0))) AS BIGINT) AS confidence_scaled, CAST(v AS DOUBLE) / 1e8 AS value_back,
       CAST(CASE WHEN seq % 5 = 0 THEN 0 ELSE abs(v - seq % 5 * 1000) * 10000 // (seq % 5 * 1000) END AS BIGINT) AS bps FROM s
""",
)
add(
    "rfc3339_round_trip",
    (c.EV,),
    f"SELECT event_id, {RFC.format('ts')} AS text, epoch_ms(ts) AS ms, CASE WHEN k % 2 = 0 THEN '0x' || sha256({RFC.format('ts')}) ELSE {RFC.format('ts')} END AS shown FROM ev",
)

# ---------------------------------------------------------------- research
B0, A0, M0 = "COALESCE(bid_price, 0e0)", "COALESCE(ask_price, 0e0)", "COALESCE(mark_price, 0e0)"
add(
    "quote_selector",
    HIST,
    f"""
SELECT venue, currency, timestamp, round(sum(CASE WHEN {B0} > 0 AND {A0} > 0 THEN 0.5e0 * ({B0} + {A0}) ELSE {M0} END), 6) AS mid, round(sum({M0}), 6) AS mark,
       round(sum({B0}), 6) AS bid, round(sum({A0}), 6) AS ask FROM hist GROUP BY ALL
""",
)
add("top_of_hour", HIST, "SELECT venue, currency, timestamp, count(*) AS n FROM hour_rows GROUP BY ALL")
add(
    "pivot_sides",
    BASELINE,
    "SELECT snapshot_ts, venue, asset, expiry, count(*) AS strikes, round(sum(call), 5) AS call, round(sum(put), 5) AS put, round(sum(iv), 5) AS iv, round(max(iv), 6) AS iv_max FROM mid GROUP BY ALL",
)
ZERO = """
zi AS (SELECT *, CAST((strike - 40) / 4 AS INTEGER) + day(snapshot_ts) AS zi FROM mid),
zeroed AS (SELECT * EXCLUDE (zi) REPLACE (
  CASE WHEN strike > 120 AND (zi % 7 IN (2, 3) OR zi % 11 = 4) THEN 0e0 ELSE call END AS call,
  CASE WHEN strike < 80 AND (zi % 9 IN (5, 6) OR zi % 5 = 1) THEN 0e0 ELSE put END AS put) FROM zi)
"""
WING = (*BASELINE, ZERO, c.listed_variance("v", "zeroed"))
add(
    "wing_termination",
    WING,
    "SELECT snapshot_ts, venue, asset, expiry, side, count(*) AS strikes, min(strike) AS lowest, max(strike) AS highest, sum(strike) AS strike_sum, round(sum(q), 5) AS q FROM v_strip GROUP BY ALL",
)
add("strike_intervals", WING, "SELECT snapshot_ts, venue, asset, expiry, count(*) AS strikes, sum(delta_k) AS width, sum(delta_k * strike) AS weighted FROM v_d WHERE delta_k IS NOT NULL GROUP BY ALL")
LISTED = (*BASELINE, c.listed_variance("v", "mid"))
add("listed_variance", LISTED, "SELECT snapshot_ts, venue, asset, expiry, strikes, k_zero, round(forward, 6) AS forward, round(sigma_sq, 6) AS sigma_sq FROM v")
add(
    "resample_last",
    HIST,
    """
, b AS (SELECT *, max(date_trunc('hour', timestamp)) OVER (PARTITION BY venue, currency ORDER BY arrival_seq, asq RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bucket
        FROM (SELECT *, upper(currency) || '-' || upper(strftime(expiration, '%-d%b%y')) || '-' || CAST(strike_price AS INTEGER) || '-' || CASE type WHEN 'call' THEN 'C' ELSE 'P' END AS asq FROM hist)),
l AS (SELECT venue, currency, asq, bucket, max(arrival_seq) AS arrival_seq, last(ask_price ORDER BY arrival_seq, timestamp) AS ask_price FROM b GROUP BY ALL)
SELECT venue, currency, bucket AS timestamp, count(*) AS rows, count(DISTINCT asq) AS symbols, CAST(sum(arrival_seq) AS BIGINT) AS arrival_sum, round(sum(ask_price), 5) AS ask_sum FROM l GROUP BY ALL
""".replace("ORDER BY arrival_seq, asq RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ORDER BY arrival_seq, asq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
)
SER = (c.EV, c.BASE, LEVELS, c.BENCHMARK, """
series AS (SELECT index_id, CASE index_id WHEN 'BTCV30' THEN 'btc' ELSE 'eth' END AS asset, snapshot_ts, max(value) AS index_value FROM vals GROUP BY ALL),
joined AS (SELECT s.*, c.close AS benchmark FROM series s JOIN candles c ON c.asset = s.asset AND c.timestamp = s.snapshot_ts),
errs AS (SELECT *, (index_value - benchmark) / benchmark AS rel, abs((index_value - benchmark) / benchmark) AS ab FROM joined)
""")
add(
    "benchmark_exact",
    SER,
    "SELECT s.index_id, s.snapshot_ts, s.index_value, c.open AS benchmark FROM series s JOIN candles c ON c.asset = s.asset AND c.timestamp = s.snapshot_ts",
)
add(
    "benchmark_nearest",
    SER,
    """
, p AS (SELECT index_id, asset, index_value, snapshot_ts + to_minutes(30 * (hour(snapshot_ts) % 3)) AS snapshot_ts FROM series),
m AS (SELECT p.index_id, p.snapshot_ts, first(c.close ORDER BY abs(epoch_us(p.snapshot_ts) - epoch_us(c.timestamp)), c.timestamp DESC) AS benchmark
      FROM p JOIN candles c ON c.asset = p.asset AND c.timestamp BETWEEN p.snapshot_ts - INTERVAL 30 MINUTE AND p.snapshot_ts + INTERVAL 30 MINUTE GROUP BY ALL)
SELECT p.index_id, p.snapshot_ts, p.index_value, m.benchmark FROM p LEFT JOIN m USING (index_id, snapshot_ts)
""",
)
SUMMARY = "count(*) AS n, round(avg(rel), 6) AS bias, round(median(ab), 6) AS median_abs, round(quantile_cont(ab, 0.95), 6) AS p95_abs, round(avg(CASE WHEN ab <= 0.05e0 THEN 1e0 ELSE 0e0 END), 6) AS hit_share"
add(
    "error_summary",
    SER,
    f"SELECT asset, strftime(snapshot_ts, '%Y-%m-%d') AS date, {SUMMARY} FROM errs GROUP BY asset, strftime(snapshot_ts, '%Y-%m-%d') UNION ALL SELECT 'all', NULL, {SUMMARY} FROM errs",
)
add("benchmark_correlation", SER, "SELECT asset, round(corr(index_value, benchmark), 6) AS correlation FROM joined GROUP BY asset")
add("worst_errors", SER, "SELECT index_id, snapshot_ts, round(ab, 6) AS abs_err FROM errs ORDER BY ab DESC, index_id, snapshot_ts LIMIT 20")


def listed_index(name: str, var: str, legs: str, near: str = "arg_max") -> str:
    """CTE {name}: index per (snapshot, venue, asset) from listed variances."""
    return f"""
{name}_c AS (SELECT f.snapshot_ts, f.venue, f.asset, f.expiry, f.t, v.sigma_sq FROM {var}_f f LEFT JOIN {var} v USING (snapshot_ts, venue, asset, expiry) WHERE f.n >= 5 AND f.t > 0),
{name}_p AS (SELECT snapshot_ts, venue, asset, {near}({{'t': t, 's': sigma_sq}}, t) FILTER (WHERE t >= 7e0/365e0 AND t < 30e0/365e0) AS a,
                    arg_min({{'t': t, 's': sigma_sq}}, t) FILTER (WHERE t > 30e0/365e0) AS z FROM {name}_c GROUP BY ALL),
{name}_s AS (SELECT DISTINCT snapshot_ts, venue, asset FROM hour_rows),
{name}_t AS (SELECT s.*, a, z, (a.t * a.s * (z.t * 525600e0 - 43200e0) + z.t * z.s * (43200e0 - a.t * 525600e0)) / (z.t * 525600e0 - a.t * 525600e0) * 525600e0 / 43200e0 AS total
             FROM {name}_s s LEFT JOIN {name}_p USING (snapshot_ts, venue, asset)),
{name}_u AS (SELECT *, CASE WHEN a IS NULL OR z IS NULL THEN 'no_expiry_pair' WHEN a.s IS NULL OR z.s IS NULL THEN 'compute_err:thin_strip'
                            WHEN a.s < 0 OR z.s < 0 THEN 'compute_err:negative_variance' WHEN total < 0 THEN 'compute_err:interpolation' ELSE 'ok' END AS status FROM {name}_t),
{name} AS (SELECT snapshot_ts, venue, asset, status, CASE WHEN status = 'ok' THEN 100e0 * sqrt(total) END AS index_value FROM {name}_u)
"""


NEAREST = """
near_b AS (SELECT r.snapshot_ts, r.venue, r.asset, first(c.close ORDER BY abs(epoch_us(r.snapshot_ts) - epoch_us(c.timestamp)), c.timestamp DESC) AS benchmark
           FROM res r JOIN candles c ON c.asset = r.asset AND c.timestamp BETWEEN r.snapshot_ts - INTERVAL 30 MINUTE AND r.snapshot_ts + INTERVAL 30 MINUTE GROUP BY ALL),
back AS (SELECT r.*, b.benchmark FROM res r LEFT JOIN near_b b USING (snapshot_ts, venue, asset))
"""
BACK = (*LISTED, c.BENCHMARK, listed_index("res", "v", "mid"), NEAREST)
add("listed_backtest", BACK, "SELECT snapshot_ts, venue, asset, status, round(index_value, 5) AS index_value, benchmark FROM back")
add(
    "status_breakdown",
    BACK,
    """
, g AS (SELECT venue, asset, strftime(snapshot_ts, '%Y-%m-%d') AS date, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'no_expiry_pair') AS no_expiry_pair,
               count(*) FILTER (WHERE starts_with(status, 'compute_err')) AS compute_err, count(*) AS n FROM back GROUP BY ALL)
SELECT venue, asset, date, ok, no_expiry_pair, compute_err, round(ok / n, 6) AS success_rate, ok / n >= 0.95e0 AS passed FROM g
""",
)
# The fitted backtest reuses the chain maths on the historical legs.
FITTED_LEGS = """
legs AS (SELECT snapshot_ts, venue, asset, expiry, strike, snapshot_ts AS latest_ts, call AS call_mid, put AS put_mid,
                CASE WHEN iv > 1e-3 THEN iv END AS call_iv, CAST(NULL AS DOUBLE) AS put_iv FROM mid)
"""
_raw = c.LEGS.replace("\nlegs AS (", "\nraw_legs AS (")
FITTED = (
    c.EV, c.BASE, _raw, c.HISTORY.replace("FROM legs l", "FROM raw_legs l"), c.listed_legs("mid", "mid"), FITTED_LEGS, c.CHAINS, c.PICKED, c.SIDES, SPLINE,
    c.SEGMENTS, c.VARIANCE, c.VENUE_INDEX, c.BENCHMARK,
    "fitted AS (SELECT v.snapshot_ts, v.venue, v.asset, v.value AS index_value, c.close AS benchmark, c.open AS benchmark_open FROM venue_index v JOIN candles c ON c.asset = v.asset AND c.timestamp = v.snapshot_ts WHERE v.status = 'ok')",
)
add("fitted_backtest", FITTED, "SELECT snapshot_ts, venue, asset, round(index_value, 5) AS index_value, benchmark FROM fitted", True)

# The whole product of quote, intrinsic filter, near rule and field.
_grid = [(q, on, near, field) for q in ("mid", "mark", "bid", "ask") for on in ("on", "off") for near in ("max", "min") for field in ("close", "open")]
_sweep = [c.listed_legs(q, q) for q in ("mark", "bid", "ask")]
_sweep += [c.listed_variance(f"{q}_{on}", q, on == "on") for q in ("mid", "mark", "bid", "ask") for on in ("on", "off")]
_sweep += [listed_index(f"r_{q}_{on}_{near}", f"{q}_{on}", "", f"arg_{near}") for q, on, near, field in _grid if field == "close"]
_rows = " UNION ALL ".join(
    f"SELECT '{q}/{on}/{near}/{field}' AS variant, r.asset, (r.index_value - c.{field}) / c.{field} AS rel FROM r_{q}_{on}_{near} r JOIN candles c ON c.asset = r.asset AND c.timestamp = r.snapshot_ts WHERE r.status = 'ok'"
    for q, on, near, field in _grid
)
_rows += " UNION ALL SELECT 'fitted/max/close', asset, (index_value - benchmark) / benchmark FROM fitted UNION ALL SELECT 'fitted/max/open', asset, (index_value - benchmark_open) / benchmark_open FROM fitted"
add(
    "variant_sweep",
    (*FITTED, *_sweep, f"sweep AS (SELECT *, abs(rel) AS ab FROM ({_rows}))"),
    f"SELECT variant, asset, {SUMMARY} FROM sweep GROUP BY variant, asset",
    True,
)
add(
    "stage_diff",
    (*PK, c.SIDES),
    """
, d AS (SELECT venue, asset, side, hour(snapshot_ts) AS h FROM sides WHERE strip_status = 'ok')
SELECT venue, asset, side, CASE WHEN h = 5 THEN 'right_missing' WHEN h % 6 = 2 THEN 'k_zero' WHEN h % 4 = 1 THEN 'sigma_sq' ELSE 'equal' END AS first_divergence, count(*) AS n FROM d GROUP BY ALL
""",
)

# ---------------------------------------------------------------- perp book
OPEN = (*PERP, c.valued("val", "open_pos", str(CLOCK)))
add("open_positions", PERP, "SELECT id, trader, index_id, is_long, collateral, leverage FROM open_pos")
add("position_marks", PERP, "SELECT p.id, p.index_id, p.entry_price, m.mark FROM open_pos p JOIN last_marks m USING (index_id)")
add(
    "position_values",
    OPEN,
    "SELECT id, CAST(notional AS BIGINT) AS notional, CAST(pnl AS BIGINT) AS pnl, CAST(funding AS BIGINT) AS funding, CAST(equity AS BIGINT) AS equity, liquidatable, liquidatable_price_only FROM val",
)
ODDP = """
oddp AS (SELECT * REPLACE (CASE WHEN id % 13 = 0 THEN 0 WHEN id % 17 = 0 THEN 11 ELSE leverage END AS leverage, CASE WHEN id % 11 = 0 THEN 0 ELSE collateral END AS collateral) FROM asked),
oddt AS (SELECT *, CAST(collateral AS HUGEINT) * leverage * 10 // 10000 AS open_fee FROM oddp),
oddr AS (SELECT *, CASE WHEN collateral = 0 THEN 'zero_collateral' WHEN leverage = 0 OR leverage > 10 THEN 'invalid_leverage' WHEN NOT usable THEN 'stale_price'
                        WHEN collateral <= open_fee THEN 'collateral_below_open_fee' END AS reject_reason FROM oddt)
"""
add(
    "open_tickets",
    (*PERP, ODDP),
    """
SELECT id, CAST(open_fee AS BIGINT) AS open_fee, reject_reason, CASE WHEN reject_reason IS NULL THEN CAST(collateral - open_fee AS BIGINT) END AS working_collateral,
       CASE WHEN reject_reason IS NULL THEN CAST((collateral - open_fee) * leverage AS BIGINT) END AS open_notional FROM oddr
""",
)
SETTLED = ("""
cls AS (SELECT *, least(notional * 10 // 10000, equity) AS close_fee, equity - least(notional * 10 // 10000, equity) AS payout FROM endings WHERE kind <> 'liquidate'),
lqs AS (SELECT *, least(CAST(collateral AS HUGEINT) * 100 // 10000, equity) AS reward FROM endings WHERE kind = 'liquidate')
""",)
add(
    "position_endings",
    PERP,
    'SELECT p.id, p.entry_price, p.collateral, p.opened_at, e.kind, e.ref, e."at" AS ended_at, e.mark AS end_mark FROM positions p LEFT JOIN endings e ON e.id = p.id',
)
add(
    "close_settlements",
    (*PERP, *SETTLED),
    "SELECT id, kind, CAST(pnl AS BIGINT) AS pnl, CAST(equity AS BIGINT) AS equity, CAST(close_fee AS BIGINT) AS close_fee, CAST(payout AS BIGINT) AS payout, CAST(collateral - payout AS BIGINT) AS vault_delta FROM cls",
)
add("liquidation_settlements", (*PERP, *SETTLED), "SELECT id, CAST(equity AS BIGINT) AS equity, CAST(reward AS BIGINT) AS reward, CAST(collateral - reward AS BIGINT) AS vault_gain FROM lqs")
add("triggered_orders", PERP, "SELECT order_id, kind, trigger_price, hit.a AS executed_at, hit.c AS executed_mark FROM trig")
add(
    "order_executions",
    PERP,
    """
SELECT t.order_id, t.position_id,
       CASE WHEN t.kind = 'limit' THEN 'open'
            WHEN p.trader = t.trader AND p.opened_at <= t.hit.a AND (e."at" IS NULL OR t.hit.a < e."at" OR (e.kind = 'order' AND e.ref = t.order_id)) THEN 'close' ELSE 'clear' END AS action
FROM trig t LEFT JOIN positions p ON p.id = t.position_id LEFT JOIN endings e ON e.id = t.position_id
""",
)
add("trader_rows", PERP, "SELECT id, trader FROM open_pos WHERE trader IN (SELECT trader FROM open_pos WHERE leverage = 10)")
add("single_trader", PERP, "SELECT id, trader FROM open_pos WHERE lower(trader) = '0xab0007'")
add(
    "book_stats",
    PERP,
    "SELECT count(*) AS open_positions, count(*) FILTER (WHERE is_long) AS longs, count(*) FILTER (WHERE NOT is_long) AS shorts, CAST(sum(collateral * leverage) AS BIGINT) AS reserved FROM open_pos",
)
DELTAS = (*PERP, *SETTLED, """
deltas AS (
  SELECT "at", seq, event_type AS kind, CASE WHEN event_type = 'deposit' THEN assets ELSE -assets END AS delta FROM flows
  UNION ALL SELECT opened_at, id, 'open_fee', CAST(open_fee AS BIGINT) FROM ticketed WHERE reject_reason IS NULL
  UNION ALL SELECT "at", id, 'close', CAST(collateral - payout AS BIGINT) FROM cls
  UNION ALL SELECT "at", id, 'liquidation', CAST(collateral - reward AS BIGINT) FROM lqs)
""")
add("vault_history", DELTAS, 'SELECT "at", seq, kind, delta, CAST(sum(delta) OVER (ORDER BY "at", seq, kind ROWS UNBOUNDED PRECEDING) AS BIGINT) AS assets FROM deltas')
add("vault_totals", DELTAS, "SELECT kind, count(*) AS n, CAST(sum(delta) AS BIGINT) AS total FROM deltas GROUP BY kind")
# The share ledger, one event after the other: the state is a row, the balances are a list.
LEDGER = (*PERP, *SETTLED, """
book AS (
  SELECT opened_at AS "at", id AS seq, 'open_fee' AS kind, CAST(open_fee AS HUGEINT) AS assets, CAST(collateral - open_fee AS HUGEINT) * leverage AS reserved FROM ticketed WHERE reject_reason IS NULL
  UNION ALL SELECT "at", id, 'close', CAST(collateral - payout AS HUGEINT), -notional FROM cls
  UNION ALL SELECT "at", id, 'liquidation', CAST(collateral - reward AS HUGEINT), -notional FROM lqs),
holding AS (SELECT holder, row_number() OVER (ORDER BY holder) AS h FROM (SELECT DISTINCT holder FROM flows)),
moves AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY "at", seq, kind) AS i, * FROM (
    SELECT "at", seq, event_type AS kind, holder, h, CAST(assets AS HUGEINT) AS amount, CAST(0 AS HUGEINT) AS assets, CAST(0 AS HUGEINT) AS reserved FROM flows JOIN holding USING (holder)
    UNION ALL SELECT "at", seq, kind, NULL, NULL, 0, assets, reserved FROM book)),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, '' AS status, CAST(0 AS HUGEINT) AS shares, CAST(0 AS HUGEINT) AS paid, CAST(0 AS HUGEINT) AS supply, CAST(0 AS HUGEINT) AS total, CAST(0 AS HUGEINT) AS held,
         (SELECT list(CAST(0 AS HUGEINT)) FROM holding) AS balances
  UNION ALL
  SELECT i, status, shares, paid, supply + shares, total + paid + assets, held + reserved, CASE WHEN h IS NULL THEN balances ELSE list_concat(balances[:h - 1], [balances[h] + shares], balances[h + 1:]) END
  FROM (
    SELECT *, CASE WHEN status <> 'ok' THEN 0 WHEN kind = 'deposit' THEN minted ELSE -amount END AS shares, CASE WHEN status <> 'ok' THEN 0 WHEN kind = 'deposit' THEN amount ELSE -redeemed END AS paid
    FROM (
      SELECT *, CASE WHEN kind = 'deposit' THEN CASE WHEN amount <= 0 THEN 'zero_assets' WHEN supply > 0 AND total <= 0 THEN 'vault_insolvent' WHEN minted = 0 THEN 'zero_shares' ELSE 'ok' END
                     WHEN kind = 'withdraw' THEN CASE WHEN amount <= 0 THEN 'zero_shares' WHEN amount > balances[h] THEN 'insufficient_shares' WHEN redeemed = 0 THEN 'zero_assets'
                                                      WHEN redeemed > greatest(total - held, 0) THEN 'exceeds_available' ELSE 'ok' END END AS status
      FROM (SELECT m.*, f.supply, f.total, f.held, f.balances, CASE WHEN f.supply = 0 THEN m.amount WHEN f.total <= 0 THEN 0 ELSE m.amount * f.supply // f.total END AS minted,
                   CASE WHEN f.supply = 0 THEN 0 ELSE m.amount * greatest(f.total, 0) // f.supply END AS redeemed
            FROM fold f JOIN moves m ON m.i = f.i + 1)))),
ledger AS (SELECT m."at", m.seq, m.kind, m.holder, m.amount, f.* EXCLUDE (i, balances), f.balances[m.h] AS balance FROM fold f JOIN moves m USING (i)),
vault AS (SELECT arg_max(supply, i) AS supply, arg_max(total, i) AS assets, arg_max(held, i) AS reserved FROM fold),
own AS (SELECT holder, CAST(sum(shares) AS HUGEINT) AS shares FROM ledger WHERE holder IS NOT NULL GROUP BY holder)
""")
add(
    "vault_report",
    LEDGER,
    """
, o AS (SELECT CAST(supply AS BIGINT) AS supply, CAST(assets AS BIGINT) AS assets, CAST(reserved AS BIGINT) AS reserved FROM vault)
SELECT *, greatest(assets - reserved, 0) AS available, CASE WHEN supply > 0 THEN CAST(assets AS DOUBLE) / CAST(supply AS DOUBLE) ELSE 1e0 END AS share_price,
       CAST(CAST(reserved AS HUGEINT) * 10000 // assets AS DOUBLE) / 100e0 AS utilization_pct FROM o
""",
    True,
)
add(
    "share_ledger",
    LEDGER,
    """
SELECT seq, "at", kind, holder, status, CAST(amount AS BIGINT) AS requested, CAST(shares AS BIGINT) AS shares, CAST(paid AS BIGINT) AS assets, CAST(balance AS BIGINT) AS balance,
       CAST(supply AS BIGINT) AS supply, CAST(total AS BIGINT) AS total_assets, CAST(held AS BIGINT) AS reserved,
       round(CASE WHEN supply > 0 THEN CAST(total AS DOUBLE) / CAST(supply AS DOUBLE) ELSE 1e0 END, 9) AS share_price FROM ledger WHERE holder IS NOT NULL
""",
    True,
)
add("holder_shares", LEDGER, "SELECT holder, CAST(shares AS BIGINT) AS shares FROM own", True)
add(
    "lp_claims",
    LEDGER,
    """
SELECT count(*) AS holders, CAST(sum(own.shares * v.assets // v.supply) AS BIGINT) AS claims, CAST(any_value(v.assets) AS BIGINT) AS assets,
       CAST(any_value(v.supply) AS BIGINT) AS supply, sum(own.shares * v.assets // v.supply) <= any_value(v.assets) AS within FROM own, vault v
""",
    True,
)
add(
    "share_conversion",
    PERP,
    """
, s AS (SELECT seq, assets, CASE WHEN seq % 6 = 0 THEN 0 ELSE assets + 1000003 END AS supply, CASE WHEN seq % 10 = 3 THEN 0 ELSE assets * 2 + 777 END AS total FROM flows)
SELECT seq, CAST(CASE WHEN supply = 0 THEN assets WHEN total = 0 THEN NULL ELSE CAST(assets AS HUGEINT) * supply // total END AS BIGINT) AS shares,
       CAST(CASE WHEN supply = 0 THEN assets ELSE CAST(assets AS HUGEINT) * total // supply END AS BIGINT) AS redeemed FROM s
""",
)
add(
    "fee_report",
    DELTAS,
    """
SELECT 'open' AS kind, count(*) AS n, CAST(sum(open_fee) AS BIGINT) AS amount FROM ticketed WHERE reject_reason IS NULL
UNION ALL SELECT 'close', count(*), CAST(sum(close_fee) AS BIGINT) FROM cls
UNION ALL SELECT 'funding', count(*) FILTER (WHERE funding > 0), CAST(sum(funding) AS BIGINT) FROM cls
""",
)
add(
    "reserve_reconciliation",
    PERP,
    """
SELECT CAST((SELECT sum(collateral * leverage) FROM positions) AS BIGINT) AS reserved,
       CAST((SELECT sum(collateral * leverage) FROM positions WHERE id IN (SELECT id FROM endings)) AS BIGINT) AS released,
       CAST((SELECT sum(collateral * leverage) FROM open_pos) AS BIGINT) AS open_notional, TRUE AS balanced
""",
)
add(
    "liquidation_prices",
    PERP,
    """
, p AS (SELECT o.id, o.is_long, o.entry_price / 1e8 AS e, m.mark / 1e8 AS mk, CASE WHEN o.id % 9 = 0 THEN 0 ELSE leverage END AS lv FROM open_pos o JOIN last_marks m USING (index_id)),
q AS (SELECT *, CASE WHEN lv = 0 THEN e WHEN is_long THEN e * (1e0 - 0.8e0 / lv) ELSE e * (1e0 + 0.8e0 / lv) END AS lp FROM p)
SELECT id, round(lp, 6) AS liquidation_price, round(abs(lp - mk) / mk * 100e0, 6) AS distance_pct FROM q
""",
)
add(
    "mark_staleness",
    PERP,
    f"""
, g AS (SELECT index_id || '/' || (("at" // 43200) % 61) AS index_id, last(mark ORDER BY "at", seq) AS mark, max("at") AS mark_at FROM marks GROUP BY index_id || '/' || (("at" // 43200) % 61))
SELECT *, {CLOCK - 86_400 + 3600} - mark_at <= 3600 AS usable FROM g
""",
)

add(
    "thinned_polls",
    (*PERP, """
moved AS (SELECT (m."at" // 900 + 1) * 900 AS poll, last(mark ORDER BY m."at", seq) FILTER (WHERE index_id = 'BTCV30') AS a0,
                 last(mark ORDER BY m."at", seq) FILTER (WHERE index_id = 'ETHV30') AS b0 FROM marks m GROUP BY 1),
polls AS (SELECT g.poll, a0, b0 FROM (SELECT unnest(range((SELECT min(poll) FROM moved), (SELECT max(poll) FROM moved) + 1, 900)) AS poll) g LEFT JOIN moved USING (poll)),
pairs0 AS (SELECT poll, last_value(a0 IGNORE NULLS) OVER w AS a, last_value(b0 IGNORE NULLS) OVER w AS b FROM polls
           WINDOW w AS (ORDER BY poll ROWS UNBOUNDED PRECEDING)),
pairs AS MATERIALIZED (SELECT poll, a, b, row_number() OVER (ORDER BY poll) AS rn FROM pairs0 WHERE a <> 0 AND b <> 0),
walk AS (
  SELECT rn, poll AS ea, a, b, 'init' AS reason FROM pairs WHERE rn = 1
  UNION ALL
  SELECT p.rn, CASE WHEN r.reason IS NULL THEN w.ea ELSE p.poll END, CASE WHEN r.reason IS NULL THEN w.a ELSE p.a END,
         CASE WHEN r.reason IS NULL THEN w.b ELSE p.b END, r.reason
  FROM walk w JOIN pairs p ON p.rn = w.rn + 1,
       LATERAL (SELECT CASE WHEN abs(p.a - w.a) * 10000 // w.a >= 1500 OR abs(p.b - w.b) * 10000 // w.b >= 1500 THEN 'deviation'
                            WHEN p.poll - w.ea >= 7200 THEN 'heartbeat' END AS reason) r)
"""),
    'SELECT ea AS "at", a, b, reason FROM walk WHERE reason IS NOT NULL',
    True,
)
add(
    "ticks_to_venue_index",
    F,
    """
, s AS (SELECT DISTINCT venue, asset, CASE WHEN ts = date_trunc('day', ts) THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS snapshot_ts
        FROM classified WHERE drop_reason = 'pass')
SELECT venue, asset, 'no_next_expiry' AS status, count(*) AS n FROM s GROUP BY ALL
""",
)

# ---------------------------------------------------------------- streams and sinks, there and back
add("streamed_bars", BARS, BAR)
add(
    "streamed_ticks",
    F,
    """
, one AS (SELECT DISTINCT venue, asset, expiry, strike, kind, received_at FROM classified WHERE drop_reason = 'pass')
SELECT venue, asset, kind, count(*) AS n, sum(strike) AS strikes FROM one GROUP BY ALL
""",
)
add("streamed_index", IDX, "SELECT index_id, ts, min(value) AS value, min(confidence) AS confidence FROM index_ticks GROUP BY ALL")
add("tick_table", T, "SELECT seq, venue, asset, strike, kind, received_at AS ts FROM ticks WHERE received_at >= TIMESTAMP '2024-01-10' AND received_at < TIMESTAMP '2024-01-12'")

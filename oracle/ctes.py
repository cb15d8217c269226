"""Common table expressions: the derived inputs and the chain maths, in DuckDB SQL."""

from __future__ import annotations

EV = """
ev AS (
  SELECT event_id, date_trunc('milliseconds', ts) AS ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)
"""

VENUE = "CASE event_id % 3 WHEN 0 THEN 'bybit' WHEN 1 THEN 'deribit' ELSE 'okx' END"
ASSET = "CASE WHEN user_id % 2 = 0 THEN 'btc' ELSE 'eth' END"
INDEX = "CASE WHEN user_id % 2 = 0 THEN 'BTCV30' ELSE 'ETHV30' END"

TICKS = f"""
ticks0 AS (
  SELECT event_id AS seq, {VENUE} AS venue, {ASSET} AS asset,
         date_trunc('day', ts) + INTERVAL 23 DAY + INTERVAL 8 HOUR AS expiry,
         20e0 + 5e0 * (user_id % 25) AS strike,
         CASE WHEN event_id % 2 = 0 THEN 'call' ELSE 'put' END AS kind,
         CASE WHEN k % 10 = 9 THEN NULL WHEN event_type = 'error' AND k % 5 = 0 THEN value * 1.01e0
              ELSE value * (1e0 - (k % 40) / 200e0) END AS bid,
         CASE WHEN k % 10 = 8 THEN NULL WHEN event_type = 'error' AND k % 5 = 0 THEN value * 0.99e0
              ELSE value * (1e0 + (k % 40) / 200e0) END AS ask,
         0.3e0 + k / 200e0 AS iv, 80e0 AS underlying, CAST(k AS DOUBLE) AS open_interest, value AS volume_24h,
         ts AS received_at, ts, k
  FROM ev),
ticks AS (
  SELECT t.* EXCLUDE (k), (bid + ask) * 0.5e0 AS mid,
         received_at + to_milliseconds((k % 7) * 1000 + c.ms) AS arrival_ts
  FROM ticks0 t JOIN (SELECT unnest([0, 500]) AS ms) c ON c.ms = 0 OR t.seq % 10 = 0)
"""

FLAGS = """
flags AS (
  SELECT *, (epoch_us(arrival_ts) - epoch_us(received_at)) / 1e6 AS age,
         COALESCE(ask <= bid OR bid < 0 OR ask < 0, FALSE) AS crossed,
         COALESCE(mid > 0 AND (ask - bid) / mid > 0.30e0, FALSE) AS wide,
         COALESCE(mid + 0.01e0 < greatest(CASE WHEN kind = 'call' THEN underlying - strike ELSE strike - underlying END, 0e0), FALSE) AS below
  FROM ticks),
classified AS (
  SELECT *, CASE WHEN NOT (age BETWEEN 0 AND 5) THEN 'stale' WHEN crossed THEN 'crossed' WHEN wide THEN 'wide_spread'
                 WHEN below THEN 'below_intrinsic' ELSE 'pass' END AS drop_reason
  FROM flags)
"""

BASE = f"""
base AS (
  SELECT date_trunc('hour', ts) + INTERVAL 1 HOUR AS snapshot_ts, {VENUE} AS venue, {ASSET} AS asset,
         CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, COUNT(*) AS n, MAX(epoch_ms(ts)) AS last_ms
  FROM ev GROUP BY ALL),
levels AS (
  SELECT snapshot_ts, venue, asset, 0.25e0 + (CAST(cents AS DOUBLE) / CAST(n AS DOUBLE)) / 20000e0 AS iv0,
         snapshot_ts - to_milliseconds(last_ms % 30000) AS latest_ts, cents % 29 AS defect
  FROM base)
"""

LEGS = """
legs0 AS (
  SELECT l.snapshot_ts, l.venue, l.asset, l.snapshot_ts + to_days(CAST(d.days AS INTEGER)) AS expiry, d.days, l.defect, l.latest_ts,
         CAST(40 + 4 * i.i AS DOUBLE) AS strike, i.i, l.iv0, ln((40 + 4 * i.i) / 101.3e0) AS x
  FROM levels l CROSS JOIN (SELECT unnest([10, 23, 30, 37, 65]) AS days) d CROSS JOIN (SELECT unnest(range(0, 41)) AS i) i
  WHERE NOT ((defect = 0 AND days < 30) OR (defect = 1 AND days > 30) OR (defect = 2 AND days <> 30)
          OR (defect = 3 AND days < 30 AND i.i % 11 <> 0) OR (defect = 6 AND days < 30 AND 40 + 4 * i.i < 101.3e0))),
legs1 AS (SELECT *, iv0 * (1e0 + 0.1e0 * x * x) AS iv, days / 365e0 AS tt FROM legs0),
legs2 AS (SELECT *, 0.4e0 * 101.3e0 * iv * sqrt(tt) * exp(-x * x / (2e0 * iv * iv * tt)) AS tv FROM legs1),
legs AS (
  SELECT snapshot_ts, venue, asset, expiry, strike, latest_ts, i, days, defect,
         greatest(101.3e0 - strike, 0e0) + tv AS call_mid,
         CASE WHEN NOT (defect = 4 AND days > 30) THEN greatest(strike - 101.3e0, 0e0) + tv END AS put_mid,
         CASE WHEN defect <> 5 THEN iv END AS call_iv, iv AS put_iv
  FROM legs2)
"""

CHAINS = """
chains0 AS (
  SELECT snapshot_ts, venue, asset, expiry, max(latest_ts) AS latest_ts,
         (epoch_us(expiry) - epoch_us(snapshot_ts)) / 1e6 / 31536000e0 AS t,
         count(COALESCE(call_iv, put_iv)) AS listed_strikes,
         first({'k': strike, 'c': call_mid, 'p': put_mid} ORDER BY abs(call_mid - put_mid), strike)
           FILTER (WHERE call_mid > 1e-9 AND put_mid > 1e-9) AS best,
         min(strike) FILTER (WHERE COALESCE(call_iv, put_iv) IS NOT NULL) AS k_min,
         max(strike) FILTER (WHERE COALESCE(call_iv, put_iv) IS NOT NULL) AS k_max
  FROM legs GROUP BY snapshot_ts, venue, asset, expiry),
chains1 AS (SELECT *, best.k AS parity_strike, best.k + (best.c - best.p) AS forward FROM chains0),
chains AS (
  SELECT *, CASE WHEN t <= 0 THEN 'non_positive_t' WHEN forward IS NULL THEN 'no_two_sided_strike' WHEN forward <= 0 THEN 'forward_outside_range'
                 WHEN listed_strikes < 5 THEN 'too_few_iv' WHEN forward < k_min OR forward > k_max THEN 'forward_outside_range' ELSE 'ok' END AS strip_status
  FROM chains1)
"""

PICKED = """
picked AS (
  SELECT snapshot_ts, venue, asset, max(latest_ts) AS latest_ts,
         arg_max(expiry, t) FILTER (WHERE t >= 7e0/365e0 AND t < 30e0/365e0) AS near_expiry,
         arg_min(expiry, t) FILTER (WHERE t >= 7e0/365e0 AND t < 30e0/365e0) AS near_expiry_min,
         arg_min(expiry, t) FILTER (WHERE t > 30e0/365e0) AS next_expiry
  FROM chains GROUP BY ALL),
bracket AS (
  SELECT *, CASE WHEN near_expiry IS NOT NULL AND next_expiry IS NOT NULL THEN 'ok' WHEN near_expiry IS NOT NULL THEN 'no_next_expiry'
                 WHEN next_expiry IS NOT NULL THEN 'no_near_expiry' ELSE 'no_bracket' END AS bracket_status
  FROM picked)
"""

# Near and next chains with a dense id, and their spline by elimination and substitution.
SIDES = """
sides0 AS (
  SELECT b.snapshot_ts, b.venue, b.asset, s.side, CASE s.side WHEN 'near' THEN near_expiry ELSE next_expiry END AS expiry, b.bracket_status
  FROM bracket b CROSS JOIN (SELECT unnest(['near', 'next']) AS side) s),
sides AS (
  SELECT s.*, row_number() OVER () AS cid, c.t, c.forward, c.k_min, c.k_max, c.listed_strikes, c.strip_status
  FROM sides0 s JOIN chains c USING (snapshot_ts, venue, asset, expiry))
"""

SPLINE = """
knots AS MATERIALIZED (
  SELECT s.cid, l.strike AS k, ln(l.strike / s.forward) AS x, __Y__ AS y,
         row_number() OVER (PARTITION BY s.cid ORDER BY l.strike) AS i, count(*) OVER (PARTITION BY s.cid) AS n
  FROM sides s JOIN legs l USING (snapshot_ts, venue, asset, expiry)
  WHERE s.strip_status = 'ok' AND COALESCE(l.call_iv, l.put_iv) IS NOT NULL),
gaps AS (
  SELECT cid, i, n, x - lag(x) OVER w AS a, lead(x) OVER w - x AS c, (lead(y) OVER w - y) / (lead(x) OVER w - x)
         - (y - lag(y) OVER w) / (x - lag(x) OVER w) AS s
  FROM knots WINDOW w AS (PARTITION BY cid ORDER BY i)),
tri AS MATERIALIZED (SELECT cid, i, n, a, 2e0 * (a + c) AS b, c, 6e0 * s AS d FROM gaps WHERE i > 1 AND i < n),
swept AS (
  SELECT cid, i, b, c, d FROM tri WHERE i = 2
  UNION ALL
  SELECT t.cid, t.i, t.b - t.a / f.b * f.c, t.c, t.d - t.a / f.b * f.d
  FROM swept f JOIN tri t ON t.cid = f.cid AND t.i = f.i + 1),
solved AS (
  SELECT cid, i, 0e0 AS m FROM knots WHERE i = n
  UNION ALL
  SELECT w.cid, w.i, (w.d - w.c * s.m) / w.b
  FROM solved s JOIN swept w ON w.cid = s.cid AND w.i = s.i - 1),
curv AS (SELECT cid, i, m FROM solved UNION ALL SELECT cid, i, 0e0 FROM knots WHERE i = 1)
"""

SEGMENTS = """
segs AS (
  SELECT k.cid, k.i, k.n, k.k AS k0, k.x AS x0, lead(k.x) OVER w AS x1, k.y AS y0, lead(k.y) OVER w AS y1, c.m AS m0, lead(c.m) OVER w AS m1
  FROM knots k JOIN curv c USING (cid, i) WINDOW w AS (PARTITION BY k.cid ORDER BY k.i)),
grid AS (
  SELECT s.cid, s.t, s.forward, j.j, CASE WHEN j.j = 800 THEN s.k_max ELSE s.k_min + (s.k_max - s.k_min) / 800e0 * j.j END AS strike
  FROM sides s CROSS JOIN (SELECT unnest(range(0, 801)) AS j) j WHERE s.strip_status = 'ok'),
pts0 AS (
  SELECT g.*, ln(g.strike / g.forward) AS x, s.x0, s.x1, s.y0, s.y1, s.m0, s.m1, s.x1 - s.x0 AS h
  FROM grid g ASOF JOIN (SELECT * FROM segs WHERE i < n) s ON g.cid = s.cid AND g.strike >= s.k0),
pts1 AS (SELECT *, (x1 - x) / h AS a, (x - x0) / h AS b FROM pts0),
pts2 AS (
  SELECT cid, t, forward, j, strike, x,
         least(greatest(a * y0 + b * y1 + ((a * a * a - a) * m0 + (b * b * b - b) * m1) * h * h / 6e0, 1e-4), 5e0) AS iv
  FROM pts1),
pts3 AS (SELECT *, (0.5e0 * iv * iv * t - x) / (iv * sqrt(t)) AS d1 FROM pts2),
pts4 AS (SELECT *, d1 - iv * sqrt(t) AS d2 FROM pts3),
pts5 AS (SELECT *, __N1__ AS n1, __N2__ AS n2, __M1__ AS u1, __M2__ AS u2 FROM pts4),
pts6 AS (
  SELECT *, strike * u2 - forward * u1 AS put, forward * n1 - strike * n2 AS call,
         max(CASE WHEN strike <= forward THEN j END) OVER (PARTITION BY cid) AS j0
  FROM pts5),
pts AS (
  SELECT cid, t, forward, j, strike, iv, j0, CASE WHEN j = j0 THEN 0.5e0 * (put + call) WHEN strike < forward THEN put ELSE call END AS q
  FROM pts6)
"""


def ncdf(x: str) -> str:
    """Normal CDF of a column as SQL text, by the published rational approximation."""
    num = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    den = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
    z = f"least(abs({x}), 37e0)"

    def poly(cs):
        out = f"{cs[0]:.17e}"
        for v in cs[1:]:
            out = f"({out} * {z} + {v:.17e})"
        return out

    tail = f"(exp(-0.5e0 * {z} * {z}) * {poly(num)} / {poly(den)})"
    return f"(CASE WHEN {x} > 0 THEN 1e0 - {tail} ELSE {tail} END)"


SEGMENTS = (
    SEGMENTS.replace("__N1__", ncdf("d1")).replace("__N2__", ncdf("d2")).replace("__M1__", ncdf("(-d1)")).replace("__M2__", ncdf("(-d2)"))
)

VARIANCE = """
integrals AS (
  SELECT cid, any_value(t) AS t, any_value(forward) AS forward, max(strike) FILTER (WHERE j = j0) AS k_zero,
         sum(0.5e0 * (q / (strike * strike) + nq / (nk * nk)) * (nk - strike)) AS integral
  FROM (SELECT *, lead(strike) OVER w AS nk, lead(q) OVER w AS nq FROM pts WINDOW w AS (PARTITION BY cid ORDER BY j))
  GROUP BY cid),
variances AS (
  SELECT s.*, i.k_zero, i.integral,
         2e0 / s.t * i.integral - (s.forward / i.k_zero - 1e0) * (s.forward / i.k_zero - 1e0) / s.t AS sigma_sq
  FROM sides s LEFT JOIN integrals i USING (cid))
"""

VENUE_INDEX = """
wide AS (
  SELECT b.snapshot_ts, b.venue, b.asset, b.latest_ts, b.bracket_status,
         a.t AS near_t, z.t AS next_t, a.sigma_sq AS s1, z.sigma_sq AS s2, a.strip_status AS near_strip_status, z.strip_status AS next_strip_status,
         a.listed_strikes AS near_listed_strikes, z.listed_strikes AS next_listed_strikes
  FROM bracket b
  LEFT JOIN variances a ON a.side = 'near' AND (a.snapshot_ts, a.venue, a.asset) = (b.snapshot_ts, b.venue, b.asset)
  LEFT JOIN variances z ON z.side = 'next' AND (z.snapshot_ts, z.venue, z.asset) = (b.snapshot_ts, b.venue, b.asset)),
venue_total AS (
  SELECT *, near_t * 525600e0 AS n1, next_t * 525600e0 AS n2,
         (near_t * s1 * (next_t * 525600e0 - 43200e0) + next_t * s2 * (43200e0 - near_t * 525600e0))
           / (next_t * 525600e0 - near_t * 525600e0) * 525600e0 / 43200e0 AS total
  FROM wide),
venue_rows AS MATERIALIZED (
  SELECT *, CASE WHEN bracket_status <> 'ok' THEN bracket_status WHEN near_strip_status <> 'ok' THEN 'near_strip'
                 WHEN next_strip_status <> 'ok' THEN 'next_strip' WHEN s1 < 0 THEN 'near_variance' WHEN s2 < 0 THEN 'next_variance'
                 WHEN total < 0 THEN 'interp' ELSE 'ok' END AS status
  FROM venue_total),
venue_index AS (
  SELECT * REPLACE (max(latest_ts) OVER (PARTITION BY snapshot_ts, venue) AS latest_ts),
         CASE WHEN status = 'ok' THEN 100e0 * sqrt(total) END AS value
  FROM venue_rows)
"""

INDEX_TICKS = f"""
index_ticks AS (
  SELECT {INDEX} AS index_id, value, k / 100e0 AS confidence, sha256(CAST(event_id AS VARCHAR)) AS strip_hash_hex, ts, event_id AS seq
  FROM ev)
"""

BARS = """
bars AS (
  SELECT index_id, date_trunc('minute', ts) AS bucket, first(value ORDER BY ts, seq) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, seq) AS close, count(*) AS count, avg(confidence) AS avg_confidence
  FROM index_ticks GROUP BY ALL)
"""


def history(name: str, minutes: int) -> str:
    return f"""
{name} AS (
  SELECT index_id, to_timestamp(epoch(bucket)::BIGINT // {minutes * 60} * {minutes * 60})::TIMESTAMP AS ts, arg_min(open, bucket) AS open, max(high) AS high,
         min(low) AS low, arg_max(close, bucket) AS close, CAST(sum(count) AS BIGINT) AS count, avg(avg_confidence) AS avg_confidence
  FROM bars GROUP BY ALL)
"""


BENCHMARK = f"""
candles AS (
  SELECT {ASSET} AS asset, date_trunc('hour', ts) AS timestamp, first(20e0 + value / 10e0 ORDER BY ts, event_id) AS open,
         max(20e0 + value / 10e0) AS high, min(20e0 + value / 10e0) AS low, last(20e0 + value / 10e0 ORDER BY ts, event_id) AS close
  FROM ev GROUP BY ALL)
"""

HISTORY = """
hist0 AS (
  SELECT l.snapshot_ts, l.venue, l.asset, l.expiry, l.strike, l.i, s.kind, s.u, CASE s.kind WHEN 'call' THEN l.call_mid ELSE l.put_mid END / 100e0 AS coin,
         CASE s.kind WHEN 'call' THEN l.call_iv ELSE l.put_iv END * 100e0 AS mark_iv
  FROM legs l CROSS JOIN (SELECT kind, u FROM (SELECT unnest(['call', 'put']) AS kind) CROSS JOIN (SELECT unnest([0, 1]) AS u)) s),
hist AS (
  SELECT CASE WHEN i % 17 = 5 AND u = 1 THEN snapshot_ts - INTERVAL 30 MINUTE ELSE snapshot_ts END AS timestamp,
         concat_ws('-', asset, expiry, strike, kind) AS symbol, venue, asset AS currency, kind AS type, strike AS strike_price, expiry AS expiration,
         CASE WHEN i % 13 = 0 THEN 0e0 ELSE coin * 0.99e0 END AS bid_price, coin * 1.01e0 + u * 0.01e0 AS ask_price, coin AS mark_price,
         mark_iv, 100e0 + (CAST(epoch(snapshot_ts) AS BIGINT) * 10 + u * 5 + i % 3) % 7 * 0.125e0 AS underlying_price, CAST(epoch(snapshot_ts) AS BIGINT) * 10 + u * 5 + i % 3 AS arrival_seq
  FROM hist0),
hour_rows AS (
  SELECT *, timestamp AS snapshot_ts, currency AS asset, expiration AS expiry, first_value(underlying_price) OVER (PARTITION BY timestamp, venue, currency ORDER BY arrival_seq) AS spot
  FROM hist WHERE date_trunc('hour', timestamp) = timestamp)
"""


def listed_legs(name: str, quote: str) -> str:
    b, a, m = "COALESCE(bid_price, 0e0)", "COALESCE(ask_price, 0e0)", "COALESCE(mark_price, 0e0)"
    price = {"mid": f"CASE WHEN {b} > 0 AND {a} > 0 THEN 0.5e0 * ({b} + {a}) ELSE {m} END", "mark": m, "bid": b, "ask": a}[quote]
    return f"""
{name}_p AS (SELECT *, ({price}) * spot AS p, COALESCE(mark_iv, 0e0) / 100e0 AS ivd FROM hour_rows),
{name}_w AS (
  SELECT snapshot_ts, venue, asset, expiry, strike_price AS strike, any_value(spot) AS spot, arg_max(p, arrival_seq) FILTER (WHERE type = 'call') AS call,
         arg_max(p, arrival_seq) FILTER (WHERE type = 'put') AS put, arg_max(ivd, arrival_seq) FILTER (WHERE type = 'call') AS call_iv,
         arg_max(ivd, arrival_seq) FILTER (WHERE type = 'put') AS put_iv
  FROM {name}_p GROUP BY ALL),
{name} AS (SELECT *, COALESCE(call_iv, put_iv) AS iv FROM {name}_w WHERE call IS NOT NULL AND put IS NOT NULL)
"""


def listed_variance(name: str, legs: str, intrinsic: bool = True) -> str:
    """CTEs {name}_strip (kept strikes) and {name} (variance per chain) over listed legs."""
    put = "CASE WHEN put + 1e-9 >= greatest(strike - forward, 0e0) THEN put ELSE 0e0 END" if intrinsic else "put"
    call = "CASE WHEN call + 1e-9 >= greatest(forward - strike, 0e0) THEN call ELSE 0e0 END" if intrinsic else "call"
    return f"""
{name}_f AS (
  SELECT snapshot_ts, venue, asset, expiry, count(*) AS n, (epoch_us(expiry) - epoch_us(snapshot_ts)) / 1e6 / 31536000e0 AS t,
         first(strike + (call - put) ORDER BY abs(call - put), strike) FILTER (WHERE call > 1e-9 AND put > 1e-9) AS forward
  FROM {legs} GROUP BY snapshot_ts, venue, asset, expiry),
{name}_k AS (
  SELECT l.*, f.t, f.forward, max(CASE WHEN l.strike <= f.forward THEN l.strike END) OVER (PARTITION BY l.snapshot_ts, l.venue, l.asset, l.expiry) AS k_zero
  FROM {legs} l JOIN {name}_f f USING (snapshot_ts, venue, asset, expiry) WHERE f.n >= 5 AND f.t > 0 AND f.forward IS NOT NULL),
{name}_m AS (SELECT * REPLACE ({put} AS put, {call} AS call) FROM {name}_k WHERE k_zero IS NOT NULL),
{name}_q AS (
  SELECT *, CASE WHEN strike < k_zero THEN 'put' WHEN strike > k_zero THEN 'call' ELSE 'center' END AS side,
         CASE WHEN strike < k_zero THEN put WHEN strike > k_zero THEN call ELSE 0.5e0 * (put + call) END AS q FROM {name}_m),
{name}_z AS (
  SELECT *, q <= 0 AND COALESCE(lag(q) OVER w <= 0, FALSE) AS pair FROM {name}_q
  WINDOW w AS (PARTITION BY snapshot_ts, venue, asset, expiry, side ORDER BY abs(strike - k_zero))),
{name}_e AS (
  SELECT *, bool_or(pair) OVER (PARTITION BY snapshot_ts, venue, asset, expiry, side ORDER BY abs(strike - k_zero)) AS ended FROM {name}_z),
{name}_strip AS (SELECT * FROM {name}_e WHERE side = 'center' OR (NOT ended AND q > 0)),
{name}_d AS (
  SELECT *, CASE WHEN lag(strike) OVER w IS NOT NULL AND lead(strike) OVER w IS NOT NULL THEN 0.5e0 * (lead(strike) OVER w - lag(strike) OVER w)
                 WHEN lead(strike) OVER w IS NOT NULL THEN lead(strike) OVER w - strike ELSE strike - lag(strike) OVER w END AS delta_k
  FROM {name}_strip WINDOW w AS (PARTITION BY snapshot_ts, venue, asset, expiry ORDER BY strike)),
{name} AS (
  SELECT snapshot_ts, venue, asset, expiry, count(*) AS strikes, any_value(t) AS t, any_value(forward) AS forward, any_value(k_zero) AS k_zero,
         2e0 / any_value(t) * sum(delta_k / (strike * strike) * q)
           - (any_value(forward) / any_value(k_zero) - 1e0) * (any_value(forward) / any_value(k_zero) - 1e0) / any_value(t) AS sigma_sq
  FROM {name}_d WHERE delta_k IS NOT NULL GROUP BY snapshot_ts, venue, asset, expiry)
"""


def tdiv(a: str, b: str) -> str:
    """Division cut toward zero on huge integers."""
    return f"(CASE WHEN ({b}) = 0 THEN NULL ELSE sign({a}) * (abs(CAST({a} AS HUGEINT)) // abs(CAST({b} AS HUGEINT))) * sign({b}) END)"


def valued(name: str, source: str, now: str, own_mark: bool = False) -> str:
    notional = "CAST(p.collateral AS HUGEINT) * p.leverage"
    m = "p" if own_mark else "m"
    raw_pnl = tdiv(f"({notional}) * (CAST({m}.mark AS HUGEINT) - p.entry_price)", "p.entry_price")
    return f"""
{name}_0 AS (
  SELECT p.*{"" if own_mark else ", m.mark"}, {notional} AS notional, least(CASE WHEN p.is_long THEN {raw_pnl} ELSE -{raw_pnl} END, {notional}) AS pnl,
         ({notional}) * 30 * (({now}) - p.opened_at) // (CAST(10000 AS HUGEINT) * 86400) AS funding
  FROM {source} p{"" if own_mark else " JOIN last_marks m USING (index_id)"}),
{name} AS (
  SELECT *, greatest(0, collateral + pnl - funding) AS equity, collateral + pnl - funding <= collateral * 2000 // 10000 AS liquidatable,
         collateral + pnl <= collateral * 2000 // 10000 AS liquidatable_price_only
  FROM {name}_0)
"""


POSITIONS = f"""
requests AS (
  SELECT event_id AS id, '0xAb' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS trader, {INDEX} AS index_id, event_id % 2 = 0 AS is_long,
         CAST(round(value * 1000000) AS BIGINT) AS collateral, CAST(1 + k % 10 AS BIGINT) AS leverage,
         CAST(floor(epoch(ts)) AS BIGINT) AS opened_at, (4000 + CAST(k AS BIGINT) * 20) * 1000000 AS stop_price
  FROM ev WHERE event_type = 'purchase'),
tries AS (
  SELECT id, opened_at + 172800 AS "at", 'close' AS kind, 0 AS ref FROM requests WHERE id % 3 = 0
  UNION ALL SELECT id, opened_at + d * 86400, 'liquidate', 0 FROM requests CROSS JOIN (SELECT unnest([1, 3]) AS d)),
marks AS (
  SELECT {INDEX} AS index_id, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS "at", (4000 + CAST(round(value * 10) AS BIGINT)) * 1000000 AS mark
  FROM ev),
last_marks AS (SELECT index_id, last(mark ORDER BY "at", seq) AS mark, max("at") AS mark_at FROM marks GROUP BY index_id),
marks1 AS (SELECT index_id, "at" AS mark_at, arg_max(mark, seq) AS mark FROM marks GROUP BY ALL),
orders0 AS (
  SELECT event_id AS order_id, '0xAb' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS trader, {INDEX} AS index_id, 'limit' AS kind, CAST(NULL AS BIGINT) AS position_id,
         (4000 + CAST(k AS BIGINT) * 20) * 1000000 AS trigger_price, event_id % 2 = 0 AS trigger_above, CAST(floor(epoch(ts)) AS BIGINT) AS placed_at
  FROM ev WHERE event_type = 'signup'
  UNION ALL SELECT id, trader, index_id, CASE WHEN id % 8 = 0 THEN 'tp' ELSE 'sl' END, id, stop_price, id % 8 = 0, opened_at + CASE WHEN id % 32 = 0 THEN 172801 ELSE 600 END
  FROM requests WHERE id % 4 = 0),
trig AS (
  SELECT o.order_id, o.trader, o.kind, o.position_id, o.trigger_price, min(struct_pack(a := m."at", b := m.seq, c := m.mark)) AS hit
  FROM orders0 o JOIN marks m ON m.index_id = o.index_id AND m."at" >= o.placed_at
   AND CASE WHEN o.trigger_above THEN m.mark >= o.trigger_price ELSE m.mark <= o.trigger_price END GROUP BY ALL),
asked AS (SELECT r.*, m.mark, m.mark_at, COALESCE(r.opened_at - m.mark_at <= 3600, FALSE) AS usable
          FROM requests r ASOF LEFT JOIN marks1 m ON r.index_id = m.index_id AND r.opened_at >= m.mark_at),
tickets AS (SELECT *, CAST(collateral AS HUGEINT) * leverage * 10 // 10000 AS open_fee FROM asked),
ticketed AS (SELECT *, CASE WHEN collateral = 0 THEN 'zero_collateral' WHEN leverage = 0 OR leverage > 10 THEN 'invalid_leverage' WHEN NOT usable THEN 'stale_price'
                            WHEN collateral <= open_fee THEN 'collateral_below_open_fee' END AS reject_reason FROM tickets),
positions AS (SELECT id, trader, index_id, is_long, CAST(collateral - open_fee AS BIGINT) AS collateral, leverage, mark AS entry_price, opened_at FROM ticketed WHERE reject_reason IS NULL),
tried0 AS (
  SELECT t.*, p.* EXCLUDE (id) FROM (FROM tries UNION ALL SELECT position_id, hit.a, 'order', order_id FROM trig WHERE position_id IS NOT NULL) t
  JOIN positions p USING (id) WHERE t."at" >= p.opened_at),
tried AS (SELECT t.*, m.mark, m.mark_at FROM tried0 t ASOF JOIN marks1 m ON t.index_id = m.index_id AND t."at" >= m.mark_at),
{valued("ends0", "(SELECT * FROM tried WHERE \"at\" - mark_at <= 3600)", "p.\"at\"", True)},
endings AS (SELECT * FROM ends0 WHERE kind <> 'liquidate' OR liquidatable QUALIFY row_number() OVER (PARTITION BY id ORDER BY "at", kind, ref) = 1),
open_pos AS (SELECT * FROM positions WHERE id NOT IN (SELECT id FROM endings)),
flows AS (
  SELECT event_id AS seq, '0xAb' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS holder, CAST(floor(epoch(ts)) AS BIGINT) AS "at", CASE WHEN event_type = 'click' THEN 'deposit' ELSE 'withdraw' END AS event_type,
         CASE WHEN event_type = 'click' THEN CAST(round(value * 1000000) AS BIGINT) * 3 ELSE CAST(round(value * 1000000) AS BIGINT) // 3 END AS assets
  FROM ev WHERE event_type IN ('click', 'view'))
"""


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join(p.strip() for p in parts) + "\n"

"""Outlier policy, perp trigger search and thinning against brute force; parameters; streams."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from varstrip.operators import benchmark, index, ordered, outlier, perp, quality, rollup, shares, thinning
from varstrip.params import OutlierConfig, PerpConfig, QualityConfig, ThinningConfig
from varstrip.plans import inputs, round_trips
from varstrip.sources import historical, sinks
from varstrip.streaming import index_sink
from varstrip.streaming import rollup as stream_rollup
from varstrip.streaming import snapshots as stream_snapshots
from varstrip.streaming import ticks as stream_ticks

START = datetime(2024, 1, 1)


def brute_outliers(ticks, cfg):
    """Venue verdicts by running the state machine tick by tick."""
    streaks, dropped, out = {}, set(), {}
    for t, values in ticks:
        active, fresh, back = stream_snapshots.judge_tick(values, streaks, dropped, cfg)
        for v in values:
            out[t, v] = (streaks.get(v, 0), v in dropped, v in fresh, v in back, v in active)
    return out


def venue_rows(spark, ticks):
    rows = [("X", START + timedelta(minutes=60 * t), v, float(x)) for t, vals in ticks for v, x in vals.items()]
    return spark.createDataFrame(rows, "index_id string, snapshot_ts timestamp, venue string, value double")


def check_policy(spark, ticks, cfg):
    got = outlier.evaluate(venue_rows(spark, ticks), cfg, bucket_seconds=6 * 3600).collect()
    want = brute_outliers(ticks, cfg)
    assert len(got) == len(want)
    for r in got:
        t = int((r.snapshot_ts - START).total_seconds() // 3600)
        assert (r.streak, r.dropped, r.newly_dropped, r.newly_restored, r.active) == want[t, r.venue], (t, r)


def test_third_venue_is_dropped_at_the_fifth_tick(spark):
    ticks = [(t, {"bybit": 50, "deribit": 50, "okx": 53}) for t in range(5)] + [(5, {"bybit": 50, "deribit": 50, "okx": 51})]
    check_policy(spark, ticks, OutlierConfig())
    moves = outlier.transitions(outlier.evaluate(venue_rows(spark, ticks))).orderBy("snapshot_ts").collect()
    assert [(m.venue, m.transition) for m in moves] == [("okx", "dropped"), ("okx", "restored")]


def test_two_symmetric_venues_are_rolled_back(spark):
    check_policy(spark, [(t, {"bybit": 51.5, "okx": 48.5}) for t in range(3)], OutlierConfig(0.02, 1))


@pytest.mark.parametrize("seed", range(3))
def test_policy_matches_the_state_machine(spark, seed):
    rng = random.Random(seed)
    ticks = []
    for t in range(120):
        vals = {v: rng.choice([0.0, 48.0, 50.0, 50.5, 54.0, 60.0]) for v in ("bybit", "deribit", "okx") if rng.random() < 0.85}
        if vals:
            ticks.append((t, vals))
    check_policy(spark, ticks, OutlierConfig(0.02, 2))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 400), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40, unique_by=lambda x: x[0]))
def test_running_values_cross_buckets(spark, rows):
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, o int, v int")
    bucket = F.floor(F.col("o") / 50)
    got = ordered.running(df, ["k"], ["o"], bucket, {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, {"m_before": "m"}).orderBy("o").collect()
    prev = ordered.previous(df, ["k"], ["o"], bucket, {"p": F.col("o")}).orderBy("o").collect()
    total = best = last = None
    for r, p in zip(got, prev):
        assert (r.m_before, p.p) == (best, last)
        if r.v is not None:
            total, best = (total or 0) + r.v, r.v if best is None else max(best, r.v)
        last = r.o
        assert (r.s, r.m) == (total, best)


def test_triggers_match_a_scan(spark):
    rng = random.Random(3)
    marks = [("X", i, t, rng.randint(40, 60)) for i, t in enumerate(sorted(rng.randint(0, 40 * 86_400) for _ in range(300)))]
    orders = [(i, "X", rng.random() < 0.5, rng.randint(35, 65), rng.randint(0, 40 * 86_400)) for i in range(120)]
    m = spark.createDataFrame(marks, "index_id string, seq bigint, at bigint, mark bigint")
    o = spark.createDataFrame(orders, "order_id bigint, index_id string, trigger_above boolean, trigger_price bigint, placed_at bigint")
    got = {r.order_id: (r.executed_at, r.executed_mark) for r in perp.triggered_orders(o, m).collect()}
    want = {}
    for i, _, above, price, placed in orders:
        hit = next(((t, x) for _, _, t, x in marks if t >= placed and (x >= price if above else x <= price)), None)
        if hit:
            want[i] = hit
    assert got == want


def test_busy_quarter_joins_one_row_per_order(spark):
    """A hundred thousand marks in a quarter of an hour: ties of a second, monotone runs, late placements."""
    rng = random.Random(5)
    marks = [("X", i, 900 * 1000 + i * 900 // 100_000, 1_000_000 + (i if i < 50_000 else 100_000 - i) + rng.randint(-3, 3)) for i in range(100_000)]
    orders = [(i, "X", rng.random() < 0.5, 1_000_000 + rng.randint(-10, 50_010), 900 * 1000 + rng.randint(-2000, 900)) for i in range(300)]
    m = spark.createDataFrame(marks, "index_id string, seq bigint, at bigint, mark bigint")
    o = spark.createDataFrame(orders, "order_id bigint, index_id string, trigger_above boolean, trigger_price bigint, placed_at bigint")
    quarters, days, indices = perp.mark_levels(m)
    assert (quarters.count(), days.count(), indices.count()) == (1, 1, 1)
    rows = perp.triggered_orders(o, m).collect()
    want = {}
    for i, _, above, price, placed in orders:
        hit = next(((t, x) for _, _, t, x in marks if t >= placed and (x >= price if above else x <= price)), None)
        if hit:
            want[i] = hit
    assert {r.order_id: (r.executed_at, r.executed_mark) for r in rows} == want
    assert len(rows) == len(want) < len(orders)


@pytest.mark.parametrize("n", [1, 2, 5, 10, 999, 1001, 20_000])
def test_quantiles_by_rank(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0.25, 0.5, rng.random(), rng.random() * 1e9]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v double")
    shares = {"low": 0.0, "a": 0.01, "median": 0.5, "p95": 0.95, "high": 1.0}
    got = benchmark.quantiles(df, "v", shares).collect()[0].asDict()
    for name, p in shares.items():
        assert got[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12), name
    # Nothing but distinct values inside a bracket is ordered.
    assert benchmark.quantiles(df.filter("false"), "v", shares).collect()[0].asDict() == dict.fromkeys(shares)


def test_newest_rows_of_pieces(spark):
    rng = random.Random(2)
    rows = [(k, START + timedelta(hours=h), float(h)) for k, n in (("a", 4000), ("b", 3), ("c", 700)) for h in rng.sample(range(6000), n)]
    bars = spark.createDataFrame(rows, "index_id string, ts timestamp, close double")
    for limit in (1, 2, 700, 5000):
        got = sorted((r.index_id, r.close) for r in rollup.latest_bars(bars, limit).collect())
        want = sorted(x for k in "abc" for x in sorted(((i, c) for i, _, c in rows if i == k), reverse=True)[:limit])
        assert got == want


def brute_ledger(flows, changes):
    """One flow after the other."""
    supply = total = reserved = 0
    balances, out = {}, []
    moves = [(at, seq, kind, holder, amount, 0, 0) for seq, at, holder, kind, amount in flows] + [(at, seq, kind, None, 0, a, r) for seq, at, kind, a, r in changes]
    for at, seq, kind, holder, amount, a, r in sorted(moves, key=lambda m: m[:3]):
        if holder is None:
            total, reserved = total + a, reserved + r
            continue
        own = balances.get(holder, 0)
        if kind == "deposit":
            new = 0 if amount <= 0 or (supply and total <= 0) else amount * supply // total if supply else amount
            status = "zero_assets" if amount <= 0 else "vault_insolvent" if supply and total <= 0 else "ok" if new else "zero_shares"
            paid = amount if status == "ok" else 0
        else:
            pay = amount * max(total, 0) // supply if supply else 0
            status = "zero_shares" if amount <= 0 else "insufficient_shares" if amount > own else "zero_assets" if not pay else "exceeds_available" if pay > max(total - reserved, 0) else "ok"
            new, paid = (-amount, -pay) if status == "ok" else (0, 0)
        supply, total, balances[holder] = supply + new, total + paid, own + new
        out.append((seq, status, new, paid, own + new, supply, total, reserved))
    return sorted(out)


@pytest.mark.parametrize("chunk", [50, 700, 10_000])
def test_share_ledger_matches_a_sequential_fold(spark, chunk):
    """Losses, dust, refusals of every kind, an emptied vault, ties of a second; any cutting into chunks."""
    rng = random.Random(7)
    flows, changes = [], []
    for i in range(400):
        at, holder = rng.randint(0, 5000), f"h{rng.randint(0, 9)}"
        if rng.random() < 0.6:
            flows.append((2 * i, at, holder, "deposit", rng.choice([0, 1, 7, rng.randint(1, 10**6), 10**12])))
        else:
            flows.append((2 * i, at, holder, "withdraw", rng.choice([0, 1, rng.randint(1, 10**6), 10**11, 10**12])))
        changes.append((2 * i + 1, rng.randint(0, 5000), "close", rng.randint(-(10**5), 10**5), rng.randint(-(10**5), 10**5)))
    changes.append((1, 2500, "liquidation", -(10**15), 0))  # insolvent from here, until money comes back
    changes.append((3, 2800, "open_fee", 10**15 + 12345, 0))
    changes += [(5, 3500, "open_fee", 0, 10**16), (7, 4200, "close", 0, -(10**16))]  # nothing is available between
    f = spark.createDataFrame(flows, "seq bigint, at bigint, holder string, kind string, amount bigint")
    c = spark.createDataFrame(changes, "seq bigint, at bigint, kind string, assets bigint, reserved bigint")
    ledger = shares.share_ledger(f, c, chunk)
    got = sorted((r.seq, r.status, *(int(r[x]) for x in ("shares", "assets", "balance", "supply", "total_assets", "reserved"))) for r in ledger.collect())
    want = brute_ledger(flows, changes)
    assert got == want
    assert {w[1] for w in want} == {"ok", "zero_assets", "zero_shares", "vault_insolvent", "insufficient_shares", "exceeds_available"}
    last = want and brute_ledger(flows, changes)
    totals = shares.vault_totals(ledger, c).collect()[0]
    assert int(totals.supply) == sum(w[2] for w in last) == sum(int(r.shares) for r in shares.holder_shares(ledger).collect())
    claims = perp.lp_claims(shares.holder_shares(ledger), shares.vault_totals(ledger, c)).collect()[0]
    assert claims.within


def test_share_ledger_is_folded_batch_by_batch(spark):
    """A task hands on outcomes before it has read its chunk to the end, and keeps state across batches and wide amounts."""
    flows = [(i, i // 3, f"h{i % 4}", "withdraw" if i % 5 == 4 else "deposit", 10**17 + 7 * i) for i in range(300)]
    changes = [(1000 + i, 20 * i, "close", 10**17 * (-1) ** i, i) for i in range(5)]
    f = spark.createDataFrame(flows, "seq bigint, at bigint, holder string, kind string, amount bigint")
    c = spark.createDataFrame(changes, "seq bigint, at bigint, kind string, assets bigint, reserved bigint")
    rows = shares.ledger_events(f, c, 1000).select("chunk", "at", "seq", "kind", "holder", "amount", "assets", "reserved").orderBy("at", "seq", "kind")
    read = []
    out = shares._fold(read.append(b) or b for b in rows.toArrow().to_batches(max_chunksize=10))
    first = next(out)
    assert len(read) == 1 and 0 < first.num_rows <= 10
    assert sum(b.num_rows for b in out) + first.num_rows == len(flows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted((r.seq, r.status, *(int(r[x]) for x in ("shares", "assets", "balance", "supply", "total_assets", "reserved"))) for r in shares.share_ledger(f, c, 40).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_ledger(flows, changes)
    assert max(g[5] for g in got) > 2**63


def test_share_ledger_of_nothing(spark):
    f = spark.createDataFrame([], "seq bigint, at bigint, holder string, kind string, amount bigint")
    c = spark.createDataFrame([(1, 5, "close", 3, 4)], "seq bigint, at bigint, kind string, assets bigint, reserved bigint")
    assert shares.share_ledger(f, c).count() == 0
    assert shares.vault_totals(shares.share_ledger(f, c), c).collect()[0].assets == 3


def test_silent_slots(spark):
    """An empty hour gives a row with a reason for every slot and index."""
    times = [START + timedelta(minutes=m) for m in (0, 1, 2, 62, 63)]
    legs = spark.createDataFrame([(t, "btc") for t in times] + [(times[1], "eth")], "snapshot_ts timestamp, asset string")
    results = spark.createDataFrame([("BTCV30", t, 50.0) for t in times[:4]] + [("ETHV30", times[1], 60.0)], "index_id string, snapshot_ts timestamp, value double")
    rows = index.publish_rows(index.snapshot_grid(legs), results).collect()
    assert len(rows) == 2 * 64
    got = {(r.index_id, int((r.snapshot_ts - START).total_seconds() // 60)): (r.status, r.value) for r in rows}
    assert got["BTCV30", 2] == ("ok", 50.0) and got["BTCV30", 63] == ("no_venues_live", None) and got["ETHV30", 0] == ("missing_asset", None)
    assert all(got[i, m] == ("no_quotes", None) for i in ("BTCV30", "ETHV30") for m in range(3, 62))
    assert index.snapshot_grid(legs.filter("false")).count() == 0


def test_polls_in_quiet_stretches(spark):
    """Marks stop for hours: heartbeats go on, and the walk sees every poll."""
    marks = [("A", 1, 30, 100), ("B", 2, 95, 200), ("A", 3, 100, 101), ("B", 4, 20_000, 230), ("A", 5, 200_000, 101)]
    m = spark.createDataFrame(marks, "index_id string, seq bigint, at bigint, mark bigint")
    pairs = thinning.poll_pairs(m, "A", "B", 60, bucket_seconds=7200)
    polls = sorted(map(tuple, pairs.collect()))
    assert [p[0] for p in polls] == list(range(120, 200_041, 60))
    cfg = ThinningConfig(deviation_bps=500, heartbeat_seconds=3600)
    want, state = [], None
    for p in polls:
        why = thinning.reason_to_emit(state, *p, 500, 3600)
        if why:
            state = p
            want.append((*p, why))
    assert sorted(map(tuple, thinning.thin(pairs, cfg, 7200).collect())) == want
    assert [w[0] for w in want if w[3] == "deviation"] == [20_040] and sum(w[3] == "heartbeat" for w in want) > 50


@pytest.mark.parametrize("chunk", [600, 7200, 86_400])
def test_thinning_matches_a_single_walk(spark, chunk):
    rng = random.Random(chunk)
    at, a, b, polls = 0, 5_000_000_000, 7_000_000_000, []
    for _ in range(400):
        at += rng.choice([60, 60, 60, 60, 4000])
        a, b = a + rng.randint(-12_000_000, 12_000_000), b + rng.randint(-12_000_000, 12_000_000)
        polls.append((at, 0 if rng.random() < 0.02 else a, b))
    want, state = [], None
    for p in polls:
        if p[1] and p[2]:
            why = thinning.reason_to_emit(state, *p, 50, 1800)
            if why:
                state = p
                want.append((*p, why))
    df = spark.createDataFrame(polls, "at bigint, a bigint, b bigint")
    got = sorted(tuple(r) for r in thinning.thin(df, ThinningConfig(), chunk).collect())
    assert got == want and len({w[3] for w in want}) == 3


def test_nearest_benchmark_ties_go_to_the_later_candle(spark):
    candles = spark.createDataFrame([("btc", START, 1.0), ("btc", START + timedelta(hours=1), 2.0)], "asset string, timestamp timestamp, close double")
    probes = spark.createDataFrame([("btc", START + timedelta(minutes=m)) for m in (0, 29, 30, 31, 95)], "asset string, snapshot_ts timestamp")
    got = {int((r.snapshot_ts - START).total_seconds() // 60): r.benchmark for r in benchmark.join_nearest(probes, candles).collect()}
    assert got == {0: 1.0, 29: 1.0, 30: 2.0, 31: 2.0, 95: None}


def test_unknown_or_impossible_settings_are_refused():
    assert QualityConfig.from_dict({"max_age_secs": 2}).max_age_secs == 2
    for bad in ({"max_age": 1}, {"max_spread_ratio": -1}, {"intrinsic_tolerance": float("nan")}):
        with pytest.raises(ValueError):
            QualityConfig.from_dict(bad)
    with pytest.raises(ValueError):
        PerpConfig(funding_bps_per_day=1001)
    for bad in (0, 10_001):
        with pytest.raises(ValueError):
            rollup.check_limit(bad)


def test_documented_position_profit(spark):
    row = spark.sql("SELECT 995000000L collateral, 5L leverage, 3657450885L entry_price, 4000000000L mark, true is_long")
    assert int(row.select(perp.pnl()).first()[0]) == 465_950_000 + (4_975_000_000 * 342_549_115 // 3_657_450_885 - 465_950_000)
    assert round(int(row.select(perp.pnl()).first()[0]) / 1e6, 2) == 465.95


def test_clean_csv_round_trip(spark, tmp_path):
    from varstrip.plans.frames import history_text_rows
    from varstrip.schemas import HISTORY_CSV_COLUMNS

    rows = history_text_rows(spark, "/root/testdata/sf0.001").select(*HISTORY_CSV_COLUMNS)
    rows.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "csv"))
    got = historical.clean_chain_rows(historical.read_chain_csv(spark, str(tmp_path / "csv")))
    assert got.count() == historical.clean_chain_rows(rows).count()
    historical.write_snapshots(got.filter("currency = 'BTC'"), str(tmp_path / "snap"))
    historical.write_snapshots(got, str(tmp_path / "snap"), partial=True)
    back = historical.read_snapshots(spark, str(tmp_path / "snap"))
    full = {(r.currency, r.date) for r in back.filter("NOT is_partial").select("currency", "date").distinct().collect()}
    assert full and back.count() == got.count()
    assert all(r.currency != "BTC" for r in back.filter("is_partial").select("currency").distinct().collect())


def test_tick_table_prunes_and_clusters(spark, small, tmp_path):
    t = inputs.raw_ticks(spark, small)
    sinks.write_option_ticks(t, str(tmp_path / "ticks"), 4)
    got = sinks.read_option_ticks(spark, str(tmp_path / "ticks"), "2024-01-10", "2024-01-12")
    assert got.count() == t.filter("ts >= '2024-01-10' AND ts < '2024-01-12'").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters" in plan


def test_index_sink_ignores_replays(spark, small, tmp_path):
    rows = inputs.index_ticks(spark, small).select("index_id", "value", "confidence", "strip_hash_hex", "ts")
    path = str(tmp_path / "index")
    sinks.append_index_ticks(rows.filter("ts < '2024-01-15'"), path)
    sinks.append_index_ticks(rows, path)
    sinks.append_index_ticks(rows, path)
    assert spark.read.parquet(path).count() == rows.select("index_id", "ts").distinct().count()


def test_streamed_index_batches_replayed_and_overlapping(spark, tmp_path):
    """A batch written again, and one that overlaps earlier ones, leave every key once."""
    rows = lambda *hours: spark.createDataFrame([("X", START + timedelta(hours=h), float(h)) for h in hours], "index_id string, ts timestamp, value double")
    path = str(tmp_path / "index")
    read = lambda: sorted((int((r.ts - START).total_seconds() // 3600), r.batch) for r in index_sink.read_index(spark, path).collect())
    assert index_sink.read_index(spark, path) is None
    index_sink.write_batch(rows(1, 2, 2, 800), 0, path)
    index_sink.write_batch(rows(2, 3, 1500), 1, path)
    want = [(1, 0), (2, 0), (3, 1), (800, 0), (1500, 1)]
    assert read() == want
    for epoch, hours in ((0, (1, 2, 2, 800)), (1, (2, 3, 1500)), (0, (1, 2, 2, 800))):
        index_sink.write_batch(rows(*hours), epoch, path)
        assert read() == want
    index_sink.write_batch(rows(), 2, path)
    assert read() == want


def run(query):
    q = query.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def as_files(df, path, parts, key):
    """Write ``df`` as ``parts`` files in order of ``key`` and return the folder."""
    ordered_rows = df.repartitionByRange(parts, key).sortWithinPartitions(key)
    ordered_rows.write.mode("overwrite").parquet(path)
    return path


def test_streamed_ticks_equal_the_batch(spark, small, tmp_path):
    t = inputs.raw_ticks(spark, small)
    src = as_files(t, str(tmp_path / "in"), 1, "seq")
    stream = spark.readStream.schema(t.schema).parquet(src)
    clean = stream_ticks.clean_stream(stream, now="arrival_ts")
    run(stream_ticks.fork(clean, str(tmp_path / "table"), str(tmp_path / "topic"), str(tmp_path / "cp")))
    want = quality.deduplicate(quality.passing(t)).count()
    assert spark.read.parquet(str(tmp_path / "table")).count() == want
    assert spark.read.parquet(str(tmp_path / "topic")).count() == want


def test_a_streamed_batch_may_be_many_files(spark, small):
    """Batches and rows are the same however many files a batch is dealt over."""
    t = inputs.raw_ticks(spark, small)

    def fork(source, at):
        return stream_ticks.fork(stream_ticks.clean_stream(source, now="arrival_ts"), f"{at}/table", f"{at}/topic", f"{at}/checkpoint")

    n, want = t.count(), quality.deduplicate(quality.passing(t)).count()
    for batches, file_rows, files in ((1, n, 1), (1, n // 5 + 1, 5), (1, 10**6, 1)):
        folder = round_trips.streamed(t, "many", fork, batches, file_rows)
        stored = spark.read.parquet(f"{folder}/in")
        assert len(stored.inputFiles()) == files and stored.count() == n
        table = spark.read.parquet(f"{folder}/table")
        assert table.count() == want
        assert [r.batch for r in table.select("batch").distinct().collect()] == [0]


def test_streamed_legs_equal_the_batch(spark, small, tmp_path):
    from varstrip.operators.chain import assign_snapshots, latest_legs

    t = inputs.raw_ticks(spark, small)
    src = as_files(t, str(tmp_path / "in"), 3, "ts")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    run(stream_snapshots.leg_stream(stream, lateness="40 days").writeStream.outputMode("append").format("memory").queryName("legs_none"))
    assert spark.table("legs_none").count() == 0  # nothing final while the watermark has not passed
    run(stream_snapshots.leg_stream(stream, lateness="1 day").writeStream.outputMode("append").format("memory").queryName("legs"))
    batch = latest_legs(assign_snapshots(t)).collect()
    got = spark.table("legs").collect()
    assert got and {tuple(r) for r in got} <= {tuple(r) for r in batch}


@pytest.mark.parametrize("split", ["ts", "value"])
def test_streamed_bars_equal_the_batch(spark, small, tmp_path, split):
    """Also when later batches hold ticks of any earlier time."""
    t = inputs.index_ticks(spark, small)
    src = as_files(t, str(tmp_path / "in"), 4, split)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run(stream_rollup.write_bars(stream, str(tmp_path / "bars"), str(tmp_path / "cp")))
    cols = ["index_id", "bucket", "open", "high", "low", "close", "count"]
    got = {tuple(r) for r in stream_rollup.read_bars(spark, str(tmp_path / "bars")).select(*cols).collect()}
    assert got == {tuple(r) for r in rollup.minute_bars(t, ["ts", "seq"]).select(*cols).collect()}


def test_rerun_replaces_a_day(spark, tmp_path):
    from varstrip.sources import historical

    day = spark.sql("SELECT timestamp'2024-05-01 10:00:00' AS timestamp, 'BTC' AS currency, 'x' AS symbol")
    for _ in range(2):
        historical.write_snapshots(day, str(tmp_path / "snap"))
    historical.write_snapshots(day.withColumn("timestamp", day.timestamp + spark.sql("SELECT INTERVAL 1 DAY AS d").first().d), str(tmp_path / "snap"))
    assert historical.read_snapshots(spark, str(tmp_path / "snap")).count() == 2


def ordered_stream(spark, df, folder, splits):
    """A source whose micro-batches follow ``splits`` (conditions) one by one."""
    import os
    import time

    for i, condition in enumerate(splits):
        df.filter(condition).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):  # the file source reads oldest first
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > time.time() - 3600 and not os.path.exists(path + ".seen"):
                os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i)) if os.path.getmtime(path) > 1_700_001_000 else None
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_streamed_outliers_equal_the_batch(spark, tmp_path):
    rng = random.Random(11)
    ticks = [(t, {v: rng.choice([48.0, 50.0, 50.5, 60.0]) for v in ("bybit", "deribit", "okx")}) for t in range(60)]
    df = venue_rows(spark, ticks)
    cut = START + timedelta(hours=25)
    lit = F.lit(cut.replace(tzinfo=timezone.utc))
    stream = ordered_stream(spark, df, str(tmp_path / "in"), [F.col("snapshot_ts") < lit, F.col("snapshot_ts") >= lit])
    run(stream_snapshots.outlier_stream(stream, OutlierConfig(0.02, 2)).writeStream.outputMode("append").format("memory").queryName("verdicts"))
    cols = ["snapshot_ts", "venue", "streak", "dropped", "newly_dropped", "newly_restored", "active"]
    want = {tuple(r) for r in outlier.evaluate(df, OutlierConfig(0.02, 2)).select(*cols).collect()}
    assert {tuple(r) for r in spark.table("verdicts").select(*cols).collect()} == want


def test_streamed_thinning_equals_the_batch(spark, small, tmp_path):
    pairs = thinning.poll_pairs(inputs.marks(spark, small), "BTCV30", "ETHV30", 900)
    cfg = ThinningConfig(1500, 7200)
    middle = pairs.approxQuantile("at", [0.5], 0.0)[0]
    stream = ordered_stream(spark, pairs, str(tmp_path / "in"), [F.col("at") < middle, F.col("at") >= middle])
    run(stream_rollup.thin_stream(stream, cfg).writeStream.outputMode("append").format("memory").queryName("thinned"))
    assert sorted(map(tuple, spark.table("thinned").collect())) == sorted(map(tuple, thinning.thin(pairs, cfg).collect()))

"""Registered queries against their DuckDB oracles on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from varstrip.plans.catalog import QUERIES

# Not expressible in SQL; test_numerics covers the bytes behind the hash.
WITHOUT_ORACLE = {"hashed_index", "strip_envelopes"}
CHECKED = [
    "decode_deribit_frames", "decode_okx_frames", "decode_bybit_frames", "instrument_names", "history_csv_clean", "client_ticks",
    "tick_drop_reasons", "tuned_drop_reasons", "outlier_counters", "tick_dedup", "quality_counters", "snapshot_overlap", "latest_quotes", "latest_legs", "chain_forwards",
    "expiry_picker", "normal_cdf", "option_prices", "expiry_variance", "interpolation_cases", "outlier_state", "blended_index",
    "minute_bars", "history_5m", "ema_overlay", "live_bar", "pipeline_checks", "listed_variance", "resample_last",
    "benchmark_nearest", "error_summary", "position_values", "position_endings", "order_executions", "liquidation_settlements", "triggered_orders", "vault_history", "share_ledger", "vault_report", "lp_claims", "thinned_polls", "published_rows", "streamed_bars", "streamed_ticks", "streamed_index", "tick_table", "variant_sweep", "listed_backtest", "newest_bars",
]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        elif pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
    rows = df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, small, duck, name):
    got = driver.queries()[name](spark, small).toPandas()
    want = duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_query_has_an_oracle():
    assert set(QUERIES) - set(driver.oracle_sql()) == WITHOUT_ORACLE
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0

"""What plans must look like, and that building them does nothing."""

import pytest
from pyspark.sql import DataFrameReader

from varstrip.plans.catalog import QUERIES


# The share ledger is folded in rounds, each written before the next; streams run to their end.
ITERATIVE = {"share_ledger", "holder_shares", "vault_report", "lp_claims", "streamed_bars", "streamed_ticks", "streamed_index", "tick_table"}


def test_strips_are_computed_once(spark, small):
    """The running values of the outlier policy read one exchange twice, whatever is below it."""
    plans = {}
    for name in ("venue_index", "blended_index"):
        df = QUERIES[name](spark, small)
        df.collect()
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
    final = {k: p.split("== Initial Plan ==")[0] for k, p in plans.items()}
    assert final["blended_index"].count("Generate ") <= 1.3 * final["venue_index"].count("Generate ")
    assert "ReusedExchange" in final["blended_index"]


@pytest.mark.parametrize("name", ["tick_dedup", "latest_legs", "latest_quotes", "minute_bars"])
def test_raw_ticks_are_hash_aggregated(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan
    assert "SortAggregate" not in plan and "Sort [" not in plan


def test_frames_are_built_and_parsed_once(spark, small):
    """One JSON text and one parse per frame, also where only the rejected rows are asked for."""
    plan = QUERIES["venue_reject_counts"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == plan.count("StructsToJsonEvaluator") == 3


def test_building_queries_runs_no_job(spark, small, monkeypatch):
    reads = []
    plain = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *a, **k: (reads.append(a), plain(self, *a, **k))[1])
    spark.sparkContext.setJobGroup("build", "building every query")
    try:
        for name, query in QUERIES.items():
            if name not in ITERATIVE:
                query(spark, small)
        # Reading a file's schema is a job of its own.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("build")) <= len(reads)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

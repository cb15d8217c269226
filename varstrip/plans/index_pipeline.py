"""End-to-end index jobs: ticks or legs in, published index rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.operators import chain, index, outlier, quality
from varstrip.params import (
    INDEX_DIMENSION,
    SNAPSHOT_LOOKBACK_SECONDS,
    SNAPSHOT_SECONDS,
    VENUES_EXPECTED,
    OutlierConfig,
    QualityConfig,
)


def legs_from_ticks(
    ticks: DataFrame,
    cadence: int = SNAPSHOT_SECONDS,
    lookback: int = SNAPSHOT_LOOKBACK_SECONDS,
    config: QualityConfig = QualityConfig(),
) -> DataFrame:
    """Filter, deduplicate, snapshot and fold raw ticks into legs per strike.

    Taking the latest value per instrument is unaffected by copies, so the deduplication
    shuffle is left out here; it matters for the tick table, not for chains.
    """
    clean = quality.passing(ticks, config)
    return chain.latest_legs(chain.assign_snapshots(clean, cadence, lookback))


def venue_indices(legs: DataFrame, near_rule: str = "max") -> DataFrame:
    """Per-venue index rows of every snapshot, failures labelled, freshness per venue."""
    return index.with_venue_freshness(index.venue_index(chain.assemble_chains(legs), near_rule))


def evaluated_venues(venues: DataFrame, dimension: DataFrame, config: OutlierConfig = OutlierConfig()) -> DataFrame:
    """Successful venue rows per index with the outlier verdict."""
    good = venues.filter(F.col("status") == "ok").select(
        "snapshot_ts", "venue", "asset", "value", "latest_ts", "near_listed_strikes", "next_listed_strikes"
    )
    return outlier.evaluate(index.for_indices(good, dimension), config)


def blended_index(
    legs: DataFrame,
    dimension: DataFrame,
    config: OutlierConfig = OutlierConfig(),
    venues_expected: int = VENUES_EXPECTED,
) -> DataFrame:
    """The published index: value, confidence and venue counts per (index, snapshot)."""
    evaluated = evaluated_venues(venue_indices(legs), dimension, config)
    blended = index.blend(evaluated.filter("active"), venues_expected)
    return blended.select("index_id", "snapshot_ts", "value", "confidence", "venues_live", "strip_strikes", "primary_venue")


def hashed_index(legs: DataFrame, dimension: DataFrame, config: OutlierConfig = OutlierConfig()) -> DataFrame:
    """``blended_index`` with the audit hash over the active venues' strips."""
    chains = chain.assemble_chains(legs)
    venues = index.with_venue_freshness(index.venue_index(chains))
    active = evaluated_venues(venues, dimension, config).filter("active")
    digests = index.strip_hash(index.venue_strips(chains), active, dimension)
    blended = index.blend(active)
    return blended.join(digests, ["index_id", "snapshot_ts"]).select(
        "index_id", F.col("snapshot_ts").alias("ts"), "value", "confidence", "strip_hash_hex"
    )


def published_rows(
    legs: DataFrame, dimension: DataFrame, config: OutlierConfig = OutlierConfig(), indices=INDEX_DIMENSION, cadence: int = SNAPSHOT_SECONDS
) -> DataFrame:
    """A row for every index and slot of the cadence, with the reason where there is no value."""
    evaluated = evaluated_venues(venue_indices(legs), dimension, config)
    blended = index.blend(evaluated.filter("active")).select("index_id", "snapshot_ts", "value", "confidence")
    return index.publish_rows(index.snapshot_grid(legs, indices, cadence), blended)

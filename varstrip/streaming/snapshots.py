"""Incremental snapshots: latest quotes per bar, and the outlier policy across bars."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from varstrip.operators.chain import assign_snapshots, latest_legs
from varstrip.operators.outlier import EPSILON
from varstrip.params import SNAPSHOT_LOOKBACK_SECONDS, SNAPSHOT_SECONDS, OutlierConfig


def leg_stream(
    ticks: DataFrame,
    cadence: int = SNAPSHOT_SECONDS,
    lookback: int = SNAPSHOT_LOOKBACK_SECONDS,
    lateness: str = "5 seconds",
) -> DataFrame:
    """Legs per strike of every completed bar, in append mode.

    Every bar is built from its own ticks only, so its state is dropped as soon as the
    watermark passes the bar: this is the 30-second expiry of a live quote table.
    """
    barred = assign_snapshots(ticks, cadence, lookback)
    return latest_legs(barred.withWatermark("snapshot_ts", lateness))


VERDICT = (
    "index_id string, snapshot_ts timestamp, venue string, value double, streak bigint, "
    "dropped boolean, newly_dropped boolean, newly_restored boolean, active boolean"
)
TRACKER_STATE = "venues array<string>, streaks array<bigint>, dropped array<boolean>"


def judge_tick(values: dict[str, float], streaks: dict[str, int], dropped: set[str], config: OutlierConfig) -> tuple[set, set, set]:
    """Advance the policy by one tick in place; returns (active, newly dropped, restored)."""
    if len(values) < 2:
        return set(values), set(), set()
    middle = median(sorted(values.values()))
    if not abs(middle) < float("inf") or abs(middle) < EPSILON:
        active = set(values) - dropped
        return active or set(values), set(), set()
    active, fresh, back = set(), set(), set()
    for venue, value in values.items():
        if abs((value - middle) / middle) > config.threshold:
            streaks[venue] = streaks.get(venue, 0) + 1
            if streaks[venue] < config.streak:
                active.add(venue)
            elif venue not in dropped:
                fresh.add(venue)
        else:
            streaks.pop(venue, None)
            active.add(venue)
            if venue in dropped:
                back.add(venue)
    dropped -= back
    if active:
        dropped |= fresh
        return active, fresh, back
    return fresh or set(values), set(), back


def outlier_stream(values: DataFrame, config: OutlierConfig = OutlierConfig()) -> DataFrame:
    """Verdict per venue row, with streaks and drops kept per index between batches.

    ``values`` (index_id, snapshot_ts, venue, value) must deliver bars in order, as
    ``leg_stream`` does; a batch may hold several.
    """

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streaks: dict[str, int] = {}
        dropped: set[str] = set()
        if state.exists:
            names, counts, flags = state.get
            streaks = {n: int(s) for n, s in zip(names, counts) if s}
            dropped = {n for n, d in zip(names, flags) if d}
        rows = pd.concat(list(frames))
        out = []
        for ts, tick in rows.groupby("snapshot_ts", sort=True):
            present = dict(zip(tick["venue"], tick["value"]))
            active, fresh, back = judge_tick(present, streaks, dropped, config)
            for venue in sorted(present):
                out.append((key[0], ts, venue, present[venue], streaks.get(venue, 0), venue in dropped, venue in fresh, venue in back, venue in active))
        names = sorted(set(streaks) | dropped)
        state.update((names, [streaks.get(n, 0) for n in names], [n in dropped for n in names]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in VERDICT.split(", ")])

    slim = values.select("index_id", "snapshot_ts", "venue", "value")
    return slim.groupBy("index_id").applyInPandasWithState(advance, VERDICT, TRACKER_STATE, "append", GroupStateTimeout.NoTimeout)



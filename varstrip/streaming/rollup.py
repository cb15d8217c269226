"""Incremental minute bars, and the thinned on-chain feed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from varstrip.operators.rollup import merge_bars, minute_bars
from varstrip.operators.thinning import reason_to_emit
from varstrip.params import ThinningConfig


def write_bars(ticks: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Every batch writes the partial bars of its own ticks into its own folder; replays replace it.

    There is no watermark: a tick that is hours late is one more part of its minute.
    """
    order = ["ts", "seq"] if "seq" in ticks.columns else ["ts"]

    def write(batch: DataFrame, epoch: int) -> None:
        minute_bars(batch, order).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Whole bars, merged from the parts of all batches."""
    return merge_bars(spark.read.parquet(path).drop("batch"))


def thin_stream(pairs: DataFrame, config: ThinningConfig = ThinningConfig()) -> DataFrame:
    """Emitted polls (at, a, b, reason) of every ``pair`` (one, without the column), remembering its last emission.

    ``pairs`` must deliver each pair's polls in order of ``at``, quiet ones included.
    """
    bps, heartbeat = config.deviation_bps, config.heartbeat_seconds

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        out = []
        rows = pd.concat(list(frames)).sort_values("at")
        for at, a, b in zip(rows["at"].tolist(), rows["a"].tolist(), rows["b"].tolist()):
            if a == 0 or b == 0:
                continue
            why = reason_to_emit(last, at, a, b, bps, heartbeat)
            if why:
                last = (at, a, b)
                out.append((at, a, b, why))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["at", "a", "b", "reason"])

    keyed = pairs if "pair" in pairs.columns else pairs.withColumn("pair", F.lit("pair"))
    keyed = keyed.select("pair", "at", "a", "b")
    return keyed.groupBy("pair").applyInPandasWithState(
        advance, "at bigint, a bigint, b bigint, reason string", "at bigint, a bigint, b bigint", "append", GroupStateTimeout.NoTimeout
    )

"""Incremental tick path: filter, deduplicate, fork to table and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from varstrip.operators.quality import DEDUP_KEY, drop_reason
from varstrip.params import QualityConfig
from varstrip.sources.messages import tick_messages
from varstrip.sources.sinks import TICK_CLUSTER, as_table_rows


def clean_stream(ticks: DataFrame, config: QualityConfig = QualityConfig(), now: str | None = None) -> DataFrame:
    """Passing ticks, each update once.

    Without ``now`` the arrival clock is the trigger time. The watermark keeps dedup state for
    the configured window only; ticks later than that cannot pass the staleness rule anyway.
    Counters per drop reason are reported as the observation ``tick_quality``.
    """
    df = ticks if now else ticks.withColumn("arrival_ts", F.current_timestamp())
    df = df.withColumn("drop_reason", drop_reason(config, now or "arrival_ts"))
    reasons = ("stale", "crossed", "wide_spread", "below_intrinsic")
    df = df.observe(
        "tick_quality",
        F.count(F.lit(1)).alias("received"),
        *[F.count_if(F.col("drop_reason") == r).alias(r) for r in reasons],
    )
    kept = df.filter(F.col("drop_reason") == "pass").drop("drop_reason")
    return kept.withWatermark("received_at", f"{int(config.dedup_window_secs)} seconds").dropDuplicatesWithinWatermark(DEDUP_KEY)


def fork(ticks: DataFrame, table_path: str, topic_path: str, checkpoint: str) -> DataStreamWriter:
    """One writer that feeds the tick table and the topic rows.

    Every batch overwrites its own ``batch=`` folders, so a batch that is replayed after a
    failure replaces its first attempt in both places.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            rows = as_table_rows(batch).sortWithinPartitions("month", *TICK_CLUSTER)
            rows.write.mode("overwrite").partitionBy("month").parquet(f"{table_path}/batch={epoch}")
            tick_messages(batch).write.mode("overwrite").parquet(f"{topic_path}/batch={epoch}")
        finally:
            batch.unpersist()

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

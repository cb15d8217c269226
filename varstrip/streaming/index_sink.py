"""Streaming sink of the published index series, once per (index_id, ts) whatever is replayed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

KEY = ["index_id", "ts"]


def read_index(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The rows of all batches, or None before the first one."""
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_batch(batch: DataFrame, epoch: int, path: str) -> None:
    """Write the new keys of one batch into its own folder.

    A batch that is replayed replaces its first attempt; keys of other batches, earlier ones and
    those of a replay's successors alike, are left to them. Only the months that the batch touches
    are read back, by their folders.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in KEY]
    rows = batch.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(*KEY, "_r.*").withColumn("month", F.date_format("ts", "yyyyMM").cast("int"))
    have = read_index(spark, path)
    if have is not None and "batch" in have.columns:
        months = rows.select("month").distinct()
        others = have.filter(F.col("batch") != epoch).join(F.broadcast(months), "month", "left_semi")
        rows = rows.join(others.select(*KEY), KEY, "left_anti")
    rows.write.mode("overwrite").partitionBy("month").parquet(f"{path}/batch={epoch}")


def write_index(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of published rows (index_id, ts, ...) into the table at ``path``."""
    return rows.writeStream.foreachBatch(lambda batch, epoch: write_batch(batch, epoch, path)).option("checkpointLocation", checkpoint)

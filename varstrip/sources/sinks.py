"""Table sinks: option ticks and the published index series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrip import schemas
from varstrip.params import RETENTION_YEARS

TICK_CLUSTER = ["asset", "expiry", "strike", "venue", "ts"]


def as_table_rows(ticks: DataFrame) -> DataFrame:
    """Tick table layout: ``ts`` is the receive time, ``month`` the partition."""
    carried = [c for c in ("seq",) if c in ticks.columns]
    rows = ticks.select(*schemas.TICK_COLUMNS, *carried, F.col("received_at").alias("ts"))
    return rows.withColumn("month", F.date_format("ts", "yyyyMM"))


def write_option_ticks(ticks: DataFrame, path: str, files_per_month: int | None = None) -> None:
    """Append to the month-partitioned tick table, clustered for chain reads.

    Rows are range-partitioned by month and cluster key, so a busy asset or venue is cut into
    several files by sampling and row groups keep tight statistics.
    """
    rows = as_table_rows(ticks)
    ordered = ["month", *TICK_CLUSTER]
    placed = rows.repartitionByRange(files_per_month, *ordered) if files_per_month else rows.repartitionByRange(*ordered)
    placed.sortWithinPartitions(*ordered).write.mode("append").partitionBy("month").parquet(path)


def read_option_ticks(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ticks with start <= ts < end; the month bound prunes folders, the ts bound row groups."""
    df = spark.read.parquet(path)
    if start is not None:
        lo = F.lit(start).cast("timestamp")
        df = df.filter((F.col("month") >= F.date_format(lo, "yyyyMM").cast("int")) & (F.col("ts") >= lo))
    if end is not None:
        hi = F.lit(end).cast("timestamp")
        df = df.filter((F.col("month") <= F.date_format(hi, "yyyyMM").cast("int")) & (F.col("ts") < hi))
    return df


def retained(ticks: DataFrame, today: Column, years: int = RETENTION_YEARS) -> DataFrame:
    """Ticks whose day is younger than the retention; the index series is kept for ever."""
    return ticks.filter(F.add_months(F.to_date("ts"), 12 * years) > today)


def append_index_ticks(rows: DataFrame, path: str) -> None:
    """Append published rows once per (index_id, ts); replays add nothing.

    The rollup counts every row, so duplicates must be kept out here. Only the months and
    times the batch touches are read back.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in ("index_id", "ts")]
    batch = rows.groupBy("index_id", "ts").agg(F.min(F.struct(*rest)).alias("_r")).select("index_id", "ts", "_r.*")
    batch = batch.withColumn("month", F.date_format("ts", "yyyyMM").cast("int"))
    if _exists(spark, path):
        span = rows.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
        if span.lo is None:
            return
        months = [int(t.strftime("%Y%m")) for t in (span.lo, span.hi)]
        have = spark.read.parquet(path).filter(
            F.col("month").between(*months) & F.col("ts").between(F.lit(span.lo), F.lit(span.hi))
        )
        batch = batch.join(have.select("index_id", "ts"), ["index_id", "ts"], "left_anti")
    batch.write.mode("append").partitionBy("month").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds any committed part file yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(jvm_path) and any(s.isDirectory() and "month=" in s.getPath().getName() for s in fs.listStatus(jvm_path))

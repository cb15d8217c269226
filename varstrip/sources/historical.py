"""Historical option-chain files and benchmark candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varstrip import schemas
from varstrip.functions.scalar import clean_decimal, clean_long

PREFIXES = ("BTC", "ETH")
NUMBERS = ["strike_price", "bid_price", "bid_amount", "ask_price", "ask_amount", "mark_price", "mark_iv", "underlying_price"]


def read_chain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw chain rows as text columns. Each gz file is one task, so a day should be many files."""
    schema = ", ".join(f"{c} string" for c in schemas.HISTORY_CSV_COLUMNS)
    return spark.read.schema(schema).option("header", True).csv(path)


def clean_chain_rows(raw: DataFrame, currencies: tuple[str, ...] = PREFIXES) -> DataFrame:
    """Typed rows of the wanted currencies; empty or garbled numbers become NULL.

    The prefix must match exactly: ``BTC-...`` counts, ``BTC_USDC-...`` does not.
    """
    currency = F.split_part("symbol", F.lit("-"), F.lit(1))
    df = raw.withColumn("currency", currency).filter(
        F.col("currency").isin(*currencies) & F.col("symbol").contains("-")
    )
    carried = [c for c in raw.columns if c not in schemas.HISTORY_CSV_COLUMNS]
    return df.select(
        *carried,
        F.timestamp_micros(clean_long(F.col("timestamp"))).alias("timestamp"),
        "symbol",
        "currency",
        "type",
        F.timestamp_micros(clean_long(F.col("expiration"))).alias("expiration"),
        *[clean_decimal(F.col(c)).alias(c) for c in NUMBERS],
    )


def write_snapshots(rows: DataFrame, path: str, partial: bool = False) -> None:
    """Parquet by currency and date; a partial load is kept apart and never replaces a full one.

    A rerun replaces the days it holds and leaves the others.
    """
    out = rows.withColumns({"date": F.to_date("timestamp"), "is_partial": F.lit(partial)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("currency", "date", "is_partial").parquet(path)


def read_snapshots(spark: SparkSession, path: str, currency: str | None = None) -> DataFrame:
    """Full snapshots per (currency, date), or the partial one where no full one exists."""
    df = spark.read.parquet(path)
    if currency is not None:
        df = df.filter(F.col("currency") == currency)
    days = df.select("currency", "date", "is_partial").distinct()
    best = days.groupBy("currency", "date").agg(F.min("is_partial").alias("is_partial"))
    kept = df.join(best, ["currency", "date", "is_partial"], "left_semi")
    return kept.withColumn("is_partial", F.col("is_partial").cast("boolean"))

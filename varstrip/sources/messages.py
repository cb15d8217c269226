"""Key/payload rows for message topics and key-value stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.functions.scalar import hash_display, next_update_eta, parse_rfc3339, rfc3339, seconds_between
from varstrip.operators.rollup import latest_value

TICK_FIELDS = ["strike", "kind", "bid", "ask", "mid", "iv", "underlying", "open_interest", "volume_24h"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def tick_messages(ticks: DataFrame) -> DataFrame:
    """Topic ``options:{venue}:{asset}`` and the JSON payload; absent numbers stay as null."""
    when = rfc3339(F.col("received_at"))
    body = F.struct(
        "venue", "asset", rfc3339(F.col("expiry")).alias("expiry"), *TICK_FIELDS, when.alias("received_at"), when.alias("ts")
    )
    carried = [c for c in ("seq",) if c in ticks.columns]
    return ticks.select(
        *carried,
        F.concat_ws(":", F.lit("options"), "venue", "asset").alias("topic"),
        F.to_json(body, KEEP_NULLS).alias("payload"),
    )


def index_payload() -> Column:
    return F.to_json(
        F.struct("index_id", "value", "confidence", F.col("strip_hash_hex").alias("strip_hash"), rfc3339(F.col("ts")).alias("ts")),
        KEEP_NULLS,
    )


def index_stream_messages(index_ticks: DataFrame) -> DataFrame:
    """One ``index:{id}:stream`` message per published row."""
    carried = [c for c in ("seq",) if c in index_ticks.columns]
    return index_ticks.select(*carried, F.format_string("index:%s:stream", "index_id").alias("topic"), index_payload().alias("payload"))


def index_latest_rows(index_ticks: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Upsert rows for ``index:{id}:latest``: the newest value per key."""
    return latest_value(index_ticks, order).select(
        F.format_string("index:%s:latest", "index_id").alias("key"), index_payload().alias("payload")
    )


def _leg(strip: Column) -> Column:
    return F.struct(
        strip["forward"].alias("forward"),
        strip["k_zero"].alias("k_zero"),
        strip["t"].alias("time_to_expiry_y"),
        F.transform(strip["quotes"], lambda q: F.array(q["strike"], q["q"], q["iv"])).alias("quotes"),
    )


def strip_envelopes(strips: DataFrame) -> DataFrame:
    """Key ``index:{id}:last_strip`` and the near/next envelope.

    ``strips`` holds index_id, ts and near/next structs (forward, k_zero, t, quotes).
    """
    body = F.struct("index_id", rfc3339(F.col("ts")).alias("ts"), _leg(F.col("near")).alias("near"), _leg(F.col("next")).alias("next"))
    return strips.select(F.format_string("index:%s:last_strip", "index_id").alias("key"), F.to_json(body, KEEP_NULLS).alias("payload"))


def client_ticks(messages: DataFrame, indices: list[str], now: Column) -> DataFrame:
    """Client form of stream messages of known indices: lowercase channel, epoch milliseconds.

    Unknown topics and unreadable payloads are left out; a malformed time becomes ``now``.
    """
    name = F.regexp_extract("topic", "^index:(.*):stream$", 1)
    body = F.from_json("payload", "value double, confidence double, ts string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    df = messages.withColumns({"_name": name, "_body": body}).filter(
        F.col("_name").isin(*indices) & F.col("_body._corrupt").isNull()
    )
    carried = [c for c in messages.columns if c not in ("topic", "payload")]
    return df.select(
        *carried,
        F.lit("tick").alias("type"),
        F.lower("_name").alias("channel"),
        F.coalesce(F.col("_body.value"), F.lit(0.0)).alias("value"),
        F.coalesce(F.unix_millis(parse_rfc3339(F.col("_body.ts"))), F.unix_millis(now)).alias("ts_ms"),
        F.coalesce(F.col("_body.confidence"), F.lit(0.0)).alias("confidence"),
    )


def latest_view(index_ticks: DataFrame, now: Column, order: list[str] | None = None) -> DataFrame:
    """What a client asking for the latest value gets, per index."""
    age = seconds_between(now, F.col("ts"))
    return latest_value(index_ticks, order).select(
        "index_id",
        "value",
        rfc3339(F.col("ts")).alias("ts"),
        "confidence",
        hash_display(F.col("strip_hash_hex")).alias("source_strip_hash"),
        next_update_eta(age).alias("next_update_eta_seconds"),
    )


def known_index(requests: DataFrame, dimension: DataFrame, column: str = "requested") -> DataFrame:
    """Requests for known indices, whatever their case, with the proper id attached."""
    ids = dimension.select("index_id", F.lower("index_id").alias("_key"))
    return requests.withColumn("_key", F.lower(column)).join(ids, "_key").drop("_key")

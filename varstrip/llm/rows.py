"""Rows of a caller's table, packed so that no column of theirs meets a column of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(documents: DataFrame) -> DataFrame:
    """``_name`` (doc_id and the hash of the text, as ``text.text_keys`` has it) and ``_row``, the whole row."""
    name = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return documents.select(name.alias("_name"), F.struct(*documents.columns).alias("_row"))


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def one_of_each_name(rows: DataFrame) -> DataFrame:
    """The columns of one row per name: the first one by its other columns (those that have an order)."""
    fields = rows.schema["_row"].dataType.fields
    by = [F.col("_row")[f.name] for f in fields if f.name != "text" and _ordered(f.dataType)]
    return rows.groupBy("_name").agg(F.min_by("_row", F.struct(*by)).alias("_row")).select("_row.*")

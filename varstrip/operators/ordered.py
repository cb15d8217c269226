"""Running values over long ordered series without one task per key.

A plain window over (key, time) puts a whole key into one task. Here each key is cut
into consecutive time buckets. The window runs inside (key, bucket); a one-row summary
per bucket is carried forward by a second, much smaller window; the carry is joined back
on (key, bucket). A key that holds a third of all rows is thus spread over its buckets.

Rows and summaries are two reads of one exchange: a row travels as one struct, and both
sides need the whole struct, so column pruning cannot tell the two apart and whatever is
below the exchange runs once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

_KINDS = {
    "sum": (F.sum, lambda carry, local: F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)),
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "min": (F.min, lambda carry, local: F.least(carry, local)),
}


def dealt(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> tuple[DataFrame, list[str], WindowSpec]:
    """``df`` by (keys, ``_bucket``), each row packed as ``_row``, with its number ``_n`` inside the bucket.

    Also the names of the parts, and the window over the rows of a part in their order.
    """
    parts = [*keys, "_bucket"]
    packed = df.withColumn("_bucket", bucket).select(*parts, F.struct(*df.columns).alias("_row")).repartition(*parts)
    inside = Window.partitionBy(*parts).orderBy(*[F.col(f"_row.{c}") for c in order])
    # A condition that only the window can answer, so nothing is pruned from below it.
    return packed.withColumn("_n", F.row_number().over(inside)).filter("_n > 0"), parts, inside


def last_rows(df: DataFrame, parts: list[str]) -> DataFrame:
    """The last row of every bucket of a dealt table."""
    whole = F.struct(*[c for c in df.columns if c not in parts])
    return df.groupBy(*parts).agg(F.max_by(whole, "_n").alias("_last")).select(*parts, "_last.*")


def carried(rows: DataFrame, carry: DataFrame, parts: list[str]) -> DataFrame:
    """Every row with the one row of its part; NULL-safe, as a plain equality would add filters to one side only."""
    carry = carry.withColumnsRenamed({c: f"_of_{c}" for c in parts})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in parts]
    return rows.join(carry, same, "left").drop(*[f"_of_{c}" for c in parts])


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    values: dict[str, tuple[str, Column]],
    before: dict[str, str] | None = None,
) -> DataFrame:
    """Add running sum/max/min columns, the current row included.

    ``bucket`` must never decrease along ``order`` within a key. ``before`` maps further
    column names to entries of ``values`` and gives their state just before the row.
    """
    before = before or {}
    columns = df.columns
    rows, parts, ordered = dealt(df.withColumns({f"_in_{n}": col for n, (_, col) in values.items()}), keys, order, bucket)
    here = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ahead = ordered.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns(
        {
            **{f"_local_{n}": _KINDS[k][0](F.col(f"_row._in_{n}")).over(here) for n, (k, _) in values.items()},
            **{f"_ahead_{b}": _KINDS[values[n][0]][0](F.col(f"_row._in_{n}")).over(ahead) for b, n in before.items()},
        }
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_rows(local, parts).select(
        *parts, *[_KINDS[k][0](f"_local_{n}").over(earlier).alias(f"_carry_{n}") for n, (k, _) in values.items()]
    )
    joined = carried(local, carry, parts)

    def combined(name: str, column: str) -> Column:
        return _KINDS[values[name][0]][1](F.col(f"_carry_{name}"), F.col(column))

    added = {**{n: combined(n, f"_local_{n}") for n in values}, **{b: combined(n, f"_ahead_{b}") for b, n in before.items()}}
    return joined.select(*[F.col(f"_row.{c}").alias(c) for c in columns if c not in added], *[c.alias(n) for n, c in added.items()])


def previous(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column,
    columns: dict[str, Column],
) -> DataFrame:
    """Add the value each column had on the previous row of the key (NULL on the first)."""
    rows, parts, ordered = dealt(df.withColumn("_own", F.struct(*[c.alias(n) for n, c in columns.items()])), keys, order, bucket)
    local = rows.withColumn("_local", F.lag("_row._own").over(ordered))
    carry = last_rows(local, parts).select(
        *parts, F.lag("_row._own").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")
    )
    joined = carried(local, carry, parts)
    chosen = F.when(F.col("_local").isNotNull(), F.col("_local")).otherwise(F.col("_carry"))
    return joined.select(*[F.col(f"_row.{c}").alias(c) for c in df.columns if c not in columns], *[chosen[n].alias(n) for n in columns])

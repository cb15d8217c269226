"""Share ledger of the vault: an exact fold over deposits, withdrawals and book changes, chunk by chunk.

A deposit mints floor(assets * supply / total), a withdrawal of shares redeems floor(shares * total /
supply); a withdrawal may be refused for the holder's balance or for what open positions reserve.
Every step depends on the state that all earlier steps left, and floored steps do not compose. The
time line is cut into chunks, and each chunk is folded in full by one task from an *assumed* entry
state: supply, assets and reserve, and the balances of the holders that appear in it. Exits are
added up to new entries, and the chunks whose entry has changed are folded again. Where every chunk's
entry is what the chunks before it produced, the result is the sequential one. The first chunk is
final at once and each round makes at least the next one final; as a wrong entry changes a chunk's
own minting only in proportion to what it mints, a few rounds are enough in practice.

A task walks through its chunk in Spark's sorted order and holds the balances of the chunk's holders
and one batch of rows, however many rows a chunk has; ``chunk_seconds`` sets how many tasks share the
work. Summaries are one row per chunk and
one per chunk and holder in it. Rounds are written to the shared folder, so building a ledger runs
jobs, and a lost executor costs its part of one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.functions.fixedpoint import WIDE, wide
from varstrip.sources.shared import stored

CHUNK_SECONDS = 5 * 86_400
OUTCOME = f"chunk long, at long, seq long, kind string, holder string, requested {WIDE}, status string, shares {WIDE}, assets {WIDE}, balance {WIDE}, supply {WIDE}, total_assets {WIDE}, reserved {WIDE}"
EVENT = ["chunk", "at", "seq", "kind", "holder", "amount", "assets", "reserved"]
_AMOUNT = pa.decimal128(38, 0)
_TYPES = {"long": pa.int64(), "string": pa.string(), WIDE: _AMOUNT}
_OUTCOME = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in OUTCOME.split(", "))])
# Rows that carry the entry state into a chunk's task, before all times.
VAULT, BALANCE, START = "vault", "balance", -(1 << 62)


def minted(assets: int, supply: int, total: int) -> tuple[str, int]:
    """Verdict on a deposit and the shares that it mints."""
    if assets <= 0:
        return "zero_assets", 0
    if supply and total <= 0:
        return "vault_insolvent", 0
    shares = assets * supply // total if supply else assets
    return ("ok", shares) if shares else ("zero_shares", 0)


def redeemed(shares: int, balance: int, supply: int, total: int, reserved: int) -> tuple[str, int]:
    """Verdict on a withdrawal of ``shares`` and the assets that it pays."""
    if shares <= 0:
        return "zero_shares", 0
    if shares > balance:
        return "insufficient_shares", 0
    assets = shares * max(total, 0) // supply
    if not assets:
        return "zero_assets", 0
    return ("ok", assets) if assets <= max(total - reserved, 0) else ("exceeds_available", 0)


def _values(column: pa.Array) -> list:
    """Python values of a column; amounts, nearly always below 2^63, by way of machine words."""
    if column.type != _AMOUNT:
        return column.to_pylist()
    try:
        return column.cast(pa.int64()).to_pylist()
    except pa.ArrowInvalid:
        return [None if x is None else int(x) for x in column.to_pylist()]


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if kind != _AMOUNT:
        return pa.array(values, kind)
    try:
        return pa.array(values, pa.int64()).cast(_AMOUNT)
    except (OverflowError, pa.ArrowInvalid):
        return pa.array(values, _AMOUNT)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of the flows of sorted chunks, batch by batch; a chunk's first rows, of kind ``vault``
    and ``balance``, hold the state it starts from."""
    current, supply, total, reserved = object(), 0, 0, 0
    balances: dict[str, int] = {}
    for batch in batches:
        out = []
        for chunk, at, seq, kind, holder, amount, assets, reserve in zip(*(_values(batch.column(c)) for c in EVENT), strict=True):
            if chunk != current:
                current, supply, total, reserved, balances = chunk, 0, 0, 0, {}
            if kind == VAULT:
                supply, total, reserved = int(amount), int(assets), int(reserve)
            elif kind == BALANCE:
                balances[holder] = int(amount)
            elif kind in ("deposit", "withdraw"):
                requested, balance = int(amount), balances.get(holder, 0)
                if kind == "deposit":
                    status, shares = minted(requested, supply, total)
                    paid = requested if status == "ok" else 0
                else:
                    status, paid = redeemed(requested, balance, supply, total, reserved)
                    shares, paid = (-requested, -paid) if status == "ok" else (0, 0)
                supply, total = supply + shares, total + paid
                balances[holder] = balance + shares
                out.append((chunk, at, seq, kind, holder, requested, status, shares, paid, balance + shares, supply, total, reserved))
            else:
                total, reserved = total + int(assets), reserved + int(reserve)
        columns = zip(*out, strict=True) if out else [()] * len(_OUTCOME)
        yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, _OUTCOME, strict=True)], schema=_OUTCOME)


def _folded(rows: DataFrame) -> DataFrame:
    """Outcomes of all chunks in ``rows``. Spark sorts a chunk, so its task holds balances and one batch of rows."""
    order = [F.col(c).asc_nulls_last() for c in ("at", "seq", "kind")]
    return rows.select(*EVENT).repartition("chunk").sortWithinPartitions("chunk", *order).mapInArrow(_fold, OUTCOME)


def ledger_events(flows: DataFrame, changes: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One table of everything that moves the vault.

    ``flows`` (seq, at, holder, kind, amount): assets of a deposit, shares of a withdrawal.
    ``changes`` (seq, at, kind, assets, reserved): what the book adds to the assets and to the reserve.
    """
    chunk = F.floor(F.col("at") / chunk_seconds).alias("chunk")
    none = F.lit(None)
    own = flows.select(chunk, "at", "seq", "kind", "holder", wide(F.col("amount")).alias("amount"), none.cast(WIDE).alias("assets"), none.cast(WIDE).alias("reserved"))
    book = changes.select(chunk, "at", "seq", "kind", none.cast("string").alias("holder"), none.cast(WIDE).alias("amount"), wide(F.col("assets")).alias("assets"), wide(F.col("reserved")).alias("reserved"))
    return own.unionByName(book)


def _total(c: str):
    return F.coalesce(wide(F.sum(c)), wide(F.lit(0)))


def _entries(outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """State at the entry of every chunk: the vault's, and the balance of each holder in it."""
    book = events.groupBy("chunk").agg(_total("assets").alias("assets"), _total("reserved").alias("reserved"))
    sums = outcomes.groupBy("chunk").agg(wide(F.sum("shares")).alias("shares"), wide(F.sum("assets")).alias("paid"))
    # One row per chunk.
    sums = book.join(sums, "chunk", "left").select("chunk", F.coalesce("shares", wide(F.lit(0))).alias("amount"), wide(F.col("assets") + F.coalesce("paid", wide(F.lit(0)))).alias("assets"), "reserved")
    before = "OVER (PARTITION BY vault ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    vault = sums.withColumn("vault", F.lit("vault")).select("chunk", F.lit(VAULT).alias("kind"), F.lit(None).cast("string").alias("holder"), *[F.expr(f"CAST(coalesce(sum({c}) {before}, 0) AS {WIDE}) AS {c}") for c in ("amount", "assets", "reserved")])
    own = outcomes.groupBy("chunk", "holder").agg(wide(F.sum("shares")).alias("amount"))
    before = before.replace("BY vault", "BY holder")
    zero = wide(F.lit(0))
    held = own.select("chunk", F.lit(BALANCE).alias("kind"), "holder", F.expr(f"CAST(coalesce(sum(amount) {before}, 0) AS {WIDE}) AS amount"), zero.alias("assets"), zero.alias("reserved"))
    return vault.unionByName(held).select("chunk", F.lit(START).alias("at"), F.lit(0).cast("long").alias("seq"), "kind", "holder", "amount", "assets", "reserved")


def share_ledger(flows: DataFrame, changes: DataFrame, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Every flow in the order (at, seq, kind) with its verdict, its shares and assets, the holder's
    balance, and the vault's supply, assets and reserve after it."""
    events = stored(ledger_events(flows, changes, chunk_seconds), "vault-events")
    own = events.filter("kind IN ('deposit', 'withdraw')")
    # First guess: everything is granted one to one.
    signed = F.when(F.col("kind") == "deposit", F.col("amount")).otherwise(-F.col("amount"))
    outcomes = own.select("chunk", "holder", wide(signed).alias("shares"), wide(signed).alias("assets"))
    entries, last = stored(_entries(outcomes, events), "vault-entries"), None
    while True:
        if last is None:
            rows, kept = events.unionByName(entries), None
        else:
            same = [entries[c].eqNullSafe(last[c]) for c in ("chunk", "kind", "holder", "amount", "assets", "reserved")]
            moved = entries.join(last, same, "left_anti").select("chunk").distinct()
            if moved.isEmpty():
                return outcomes
            rows = events.unionByName(entries).join(moved, "chunk", "left_semi")
            kept = outcomes.join(moved, "chunk", "left_anti")
        found = _folded(rows)
        outcomes = stored(found if kept is None else kept.unionByName(found), "vault-outcomes")
        entries, last = stored(_entries(outcomes, events), "vault-entries"), entries


def with_price(ledger: DataFrame) -> DataFrame:
    """Add the share price after every flow: assets per share, 1 where there are none."""
    supply = F.col("supply").cast("double")
    return ledger.withColumn("share_price", F.when(F.col("supply") > 0, F.col("total_assets").cast("double") / supply).otherwise(F.lit(1.0)))


def holder_shares(ledger: DataFrame) -> DataFrame:
    """Shares of every holder after all flows."""
    return ledger.groupBy("holder").agg(wide(F.sum("shares")).alias("shares"))


def vault_totals(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: supply, assets and reserve after everything."""
    own = ledger.select(F.col("shares").alias("supply"), "assets", wide(F.lit(0)).alias("reserved"))
    book = changes.select(wide(F.lit(0)).alias("supply"), wide(F.col("assets")).alias("assets"), wide(F.col("reserved")).alias("reserved"))
    return own.unionByName(book).agg(*[_total(c).alias(c) for c in ("supply", "assets", "reserved")])

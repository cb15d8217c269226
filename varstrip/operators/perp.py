"""Leveraged-position analytics over position, order, price and vault-flow tables.

Amounts are whole numbers: collateral in 6 decimals, prices in 1e8 fixed point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varstrip.functions.fixedpoint import mul_div, truncated_div, wide
from varstrip.functions.scalar import packed_order
from varstrip.operators.ordered import running
from varstrip.params import PerpConfig

BPS = 10_000
DAY = 86_400
DEFAULTS = PerpConfig()


def whole(x: Column) -> Column:
    return x.cast("bigint")


def notional() -> Column:
    return wide(F.col("collateral")) * wide(F.col("leverage"))


def pnl(mark: Column | None = None) -> Column:
    """Signed profit at ``mark``, capped at plus the notional."""
    mark = F.col("mark") if mark is None else mark
    size = wide(notional())
    raw = mul_div(size, wide(mark) - wide(F.col("entry_price")), F.col("entry_price"))
    signed = F.when(F.col("is_long"), raw).otherwise(-raw)
    return wide(F.least(signed, size))


def funding(elapsed: Column, config: PerpConfig = DEFAULTS) -> Column:
    """Borrow fee accrued over ``elapsed`` seconds."""
    return mul_div(wide(notional()) * F.lit(config.funding_bps_per_day), elapsed, F.lit(BPS * DAY))


def latest_marks(marks: DataFrame) -> DataFrame:
    """Newest mark per index, one row each; the highest ``seq`` wins a tie."""
    by = packed_order(F.col("at"), F.col("seq"))
    return marks.groupBy("index_id").agg(F.max_by("mark", by).alias("mark"), F.max("at").alias("mark_at"))


def with_marks(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Positions with the newest mark of their index; the optimizer broadcasts the few marks."""
    return positions.join(latest, "index_id")


MAX_MARK_AGE = 3600


def marks_as_of(events: DataFrame, marks: DataFrame, at: str, max_age: int = MAX_MARK_AGE, bucket_seconds: int = 600) -> DataFrame:
    """Add ``mark``, ``mark_at`` and ``usable``: the newest mark of the event's index at its time.

    A mark older than ``max_age`` is refused, so a mark matters to its own time bucket and the few
    that follow: no range join, and no window over a whole index. A mark of the same second counts;
    of several the one with the highest ``seq``.
    """
    own = marks.groupBy("index_id", "at").agg(F.max_by("mark", "seq").alias("mark"))
    bucket = lambda c: F.floor(c / bucket_seconds)
    own = own.withColumn("_b", bucket(F.col("at")))
    ends = own.groupBy("index_id", "_b").agg(F.max_by("mark", "at").alias("_mark"), F.max("at").alias("_mark_at"))
    reach = -(-max_age // bucket_seconds)
    carried = ends.withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach)))
    carried = carried.groupBy("index_id", "_b").agg(F.max_by("_mark", "_mark_at").alias("_mark"), F.max("_mark_at").alias("_mark_at"))
    row = F.struct(*events.columns)
    asked = events.select("index_id", F.col(at).alias("_at"), bucket(F.col(at)).alias("_b"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast("bigint").alias("_m"))
    told = own.select("index_id", F.col("at").alias("_at"), "_b", F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col("mark").cast("bigint").alias("_m"))
    before = Window.partitionBy("index_id", "_b").orderBy("_at", "_side")
    seen = F.last(F.when(F.col("_m").isNotNull(), F.struct("_m", "_at")), ignorenulls=True).over(before)
    rows = asked.unionByName(told).withColumn("_seen", seen).filter("_side = 1").join(carried, ["index_id", "_b"], "left")
    rows = rows.select("_row.*", F.coalesce("_seen._m", "_mark").alias("mark"), F.coalesce("_seen._at", "_mark_at").alias("mark_at"))
    usable = F.col("mark").isNotNull() & (F.col(at) - F.col("mark_at") <= max_age)
    return rows.withColumn("usable", F.coalesce(usable, F.lit(False)))


def fresh_marks(latest: DataFrame, now: Column, max_age: int = 3600) -> DataFrame:
    """Flag marks that may be traded on: set, and not older than an hour."""
    usable = F.col("mark").isNotNull() & (F.col("mark_at") > 0) & (now - F.col("mark_at") <= max_age)
    return latest.withColumn("usable", F.coalesce(usable, F.lit(False)))


def valued(marked: DataFrame, now: Column, config: PerpConfig = DEFAULTS) -> DataFrame:
    """Notional, PnL, funding, equity and the liquidation flags of marked positions."""
    df = marked.withColumns({"notional": wide(notional()), "pnl": pnl(), "funding": funding(now - F.col("opened_at"), config)})
    df = df.withColumn("_raw", wide(F.col("collateral")) + F.col("pnl") - F.col("funding"))
    maintenance = mul_div(F.col("collateral"), F.lit(BPS - config.liq_threshold_bps), F.lit(BPS))
    price_only = wide(F.col("collateral")) + F.col("pnl")
    return df.withColumns(
        {
            "equity": F.greatest(wide(F.lit(0)), wide(F.col("_raw"))),
            "liquidatable": F.col("_raw") <= maintenance,
            "liquidatable_price_only": price_only <= maintenance,
        }
    ).drop("_raw")


def open_ticket(requests: DataFrame, config: PerpConfig = DEFAULTS) -> DataFrame:
    """Economics of opening: fee, working collateral, notional, or why it is refused.

    ``requests`` carry the mark as of their time (``marks_as_of``).
    """
    fee = mul_div(wide(F.col("collateral")) * wide(F.col("leverage")), F.lit(config.open_fee_bps), F.lit(BPS))
    df = requests.withColumn("open_fee", fee)
    reason = (
        F.when(F.col("collateral") == 0, "zero_collateral")
        .when((F.col("leverage") == 0) | (F.col("leverage") > config.max_leverage), "invalid_leverage")
        .when(~F.col("usable"), "stale_price")
        .when(F.col("collateral") <= F.col("open_fee"), "collateral_below_open_fee")
    )
    df = df.withColumn("reject_reason", reason)
    good = F.col("reject_reason").isNull()
    working = F.when(good, wide(F.col("collateral")) - F.col("open_fee"))
    df = df.withColumn("working_collateral", working)
    return df.withColumn("open_notional", wide(F.col("working_collateral") * wide(F.col("leverage"))))


def lifecycles(tickets: DataFrame, attempts: DataFrame, marks: DataFrame, config: PerpConfig = DEFAULTS) -> DataFrame:
    """One row per accepted ticket: what it opened with, its ``open_fee``, and ``ending``, NULL while it is open.

    Collateral is net of the fee, the entry price is the mark. The first attempt (id, at, kind, ref)
    that its mark allows ends the position: ``kind`` is close, liquidate or order; every attempt needs
    a fresh mark and a position open by then, a liquidation also one below its maintenance, and an
    attempt that fails changes nothing. ``ending`` holds at, kind, ref, and the mark, notional, pnl,
    funding and equity at that time. Attempts travel with their position, so a position is computed
    once; whatever is asked about open or ended positions is a filter of this table.
    """
    good = tickets.filter(F.col("reject_reason").isNull())
    fields = ["trader", "index_id", "is_long", "collateral", "leverage", "entry_price", "opened_at", "open_fee"]
    own = good.withColumns({"collateral": whole(F.col("working_collateral")), "entry_price": F.col("mark"), "open_fee": whole(F.col("open_fee"))}).select("id", *fields)
    tries = attempts.groupBy("id").agg(F.collect_list(F.struct("at", "kind", "ref")).alias("_tries"))  # a few each
    rows = own.join(tries, "id", "left").withColumn("_try", F.explode_outer("_tries")).drop("_tries")
    rows = rows.withColumns({"kind": F.col("_try.kind"), "ref": F.col("_try.ref"), "at": F.coalesce("_try.at", "opened_at")}).drop("_try")
    tried = valued(marks_as_of(rows, marks, "at"), F.col("at"), config)
    allowed = F.col("usable") & (F.col("at") >= F.col("opened_at")) & ((F.col("kind") != "liquidate") | F.col("liquidatable"))
    ending = F.struct("at", "kind", "ref", "mark", "notional", "pnl", "funding", "equity")
    found = tried.groupBy("id").agg(F.first(F.struct(*fields)).alias("_own"), F.min(F.when(allowed, ending)).alias("ending"))
    return found.select("id", "_own.*", "ending")


def ended(lives: DataFrame) -> DataFrame:
    """The positions that ended, with the columns of their endings."""
    return lives.filter(F.col("ending").isNotNull()).select(*[c for c in lives.columns if c != "ending"], "ending.*")


def open_positions(lives: DataFrame) -> DataFrame:
    """The positions that were neither closed nor liquidated."""
    return lives.filter(F.col("ending").isNull()).drop("ending")


def book_changes(lives: DataFrame, config: PerpConfig = DEFAULTS) -> DataFrame:
    """What opening and ending positions do to the vault: (at, seq, kind, assets, reserved)."""
    size = wide(notional())
    equity = F.col("ending.equity")
    liquidated = F.col("ending.kind") == "liquidate"
    kept_back = F.least(F.when(liquidated, mul_div(F.col("collateral"), F.lit(config.liq_reward_bps), F.lit(BPS))).otherwise(mul_div(size, F.lit(config.close_fee_bps), F.lit(BPS))), equity)
    paid = F.when(liquidated, kept_back).otherwise(equity - kept_back)
    row = lambda at, kind, assets, reserved: F.struct(at.alias("at"), F.col("id").alias("seq"), kind.alias("kind"), wide(assets).alias("assets"), wide(reserved).alias("reserved"))
    opening = row(F.col("opened_at"), F.lit("open_fee"), F.col("open_fee"), size)
    closing = row(F.col("ending.at"), F.when(liquidated, "liquidation").otherwise("close"), wide(F.col("collateral")) - paid, -size)
    return lives.select(F.inline(F.filter(F.array(opening, F.when(F.col("ending").isNotNull(), closing)), lambda x: x.isNotNull())))


def close_settlement(ended: DataFrame, config: PerpConfig = DEFAULTS) -> DataFrame:
    """Close fee, payout and vault change of the endings by their owners or their orders."""
    fee = F.least(mul_div(F.col("notional"), F.lit(config.close_fee_bps), F.lit(BPS)), F.col("equity"))
    df = ended.filter("kind <> 'liquidate'").withColumn("close_fee", wide(fee))
    df = df.withColumn("payout", wide(F.col("equity") - F.col("close_fee")))
    return df.withColumn("vault_delta", wide(wide(F.col("collateral")) - F.col("payout")))


def liquidation_settlement(ended: DataFrame, config: PerpConfig = DEFAULTS) -> DataFrame:
    """Reward and vault gain of the liquidations."""
    reward = F.least(mul_div(F.col("collateral"), F.lit(config.liq_reward_bps), F.lit(BPS)), F.col("equity"))
    df = ended.filter("kind = 'liquidate'").withColumn("reward", wide(reward))
    return df.withColumn("vault_gain", wide(wide(F.col("collateral")) - F.col("reward")))


QUARTER = 900


def _best(rows: Column, reach) -> Column:
    """First element of an ordered array that ``reach`` accepts, or NULL."""
    return F.get(F.filter(rows, reach), F.lit(0))


def mark_levels(marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks as search levels, each one row per key with an ordered array of what lies below.

    Quarters (index_id, quarter): seconds with their extremes and their *records*, the marks that
    exceed (or undercut) all earlier ones of that second. Days: extremes of their quarters. Indices:
    extremes of their days.
    """
    inside = Window.partitionBy("index_id", "at").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    m = marks.select("index_id", "seq", "at", "mark").withColumns({"_high": F.max("mark").over(inside), "_low": F.min("mark").over(inside)})
    record = F.struct("seq", "mark")
    seconds = m.groupBy("index_id", "at").agg(
        F.max("mark").alias("high"), F.min("mark").alias("low"),
        F.sort_array(F.collect_list(F.when(F.col("_high").isNull() | (F.col("mark") > F.col("_high")), record))).alias("highs"),
        F.sort_array(F.collect_list(F.when(F.col("_low").isNull() | (F.col("mark") < F.col("_low")), record))).alias("lows"),
    )
    ends = [F.max("high").alias("high"), F.min("low").alias("low")]
    below = lambda *c: F.sort_array(F.collect_list(F.struct(*c))).alias("below")
    quarters = seconds.groupBy("index_id", F.floor(F.col("at") / QUARTER).alias("quarter")).agg(*ends, below("at", "high", "low", "highs", "lows"))
    days = quarters.groupBy("index_id", F.floor(F.col("quarter") * QUARTER / DAY).alias("day")).agg(*ends, below("quarter", "high", "low"))
    return quarters, days, days.groupBy("index_id").agg(below("day", "high", "low"))


def triggered_orders(orders: DataFrame, marks: DataFrame) -> DataFrame:
    """First mark at or after placement that meets each order's trigger.

    Orders that never trigger are absent. An order looks for the rest of its own quarter of an hour,
    then for the first later quarter of its day, then for the first later day and its first quarter,
    in arrays of extremes; in the second that is found, the first of its few records that meets the
    trigger is the mark. Every join finds at most one row per order, however many marks there are.
    """
    quarters, days, indices = mark_levels(marks)
    reach = lambda x: F.when(F.col("trigger_above"), x["high"] >= F.col("trigger_price")).otherwise(x["low"] <= F.col("trigger_price"))
    o = orders.select(F.struct(*orders.columns).alias("_row"), *[F.col(c) for c in ("order_id", "index_id", "trigger_above", "trigger_price", "placed_at")])
    o = o.withColumns({"_quarter": F.floor(F.col("placed_at") / QUARTER), "_day": F.floor(F.col("placed_at") / DAY)})

    def met(second: Column) -> Column:
        """The mark in a second that reaches the trigger."""
        exact = _best(F.when(F.col("trigger_above"), second["highs"]).otherwise(second["lows"]), lambda r: F.when(F.col("trigger_above"), r["mark"] >= F.col("trigger_price")).otherwise(r["mark"] <= F.col("trigger_price")))
        return F.when(second.isNotNull(), F.struct(second["at"].alias("at"), exact["mark"].alias("mark")))

    def looked_up(df: DataFrame, level: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with the array ``below`` of the node whose number is in the column ``name``."""
        # Orders that look nothing up get keys of their own, not one common NULL.
        own = F.coalesce(F.col(name), -1 - F.pmod(F.xxhash64("order_id"), F.lit(1 << 16)))
        return df.withColumn("_key", own).join(level.select("index_id", F.col(key).alias("_key"), "below"), ["index_id", "_key"], "left").drop("_key")

    o = looked_up(o, quarters, "quarter", "_quarter").withColumn("_hit", met(_best(F.col("below"), lambda s: (s["at"] >= F.col("placed_at")) & reach(s)))).drop("below")
    later = _best(F.col("below"), lambda q: (q["quarter"] > F.col("_quarter")) & reach(q))["quarter"]
    o = looked_up(o, days, "day", "_day").withColumn("_next", F.when(F.col("_hit").isNull(), later)).drop("below")
    # One row per index, with a number or two per day of its history.
    o = o.join(F.broadcast(indices), "index_id", "left")
    day = _best(F.col("below"), lambda d: (d["day"] > F.col("_day")) & reach(d))["day"]
    o = o.withColumn("_then", F.when(F.col("_hit").isNull() & F.col("_next").isNull(), day)).drop("below")
    o = looked_up(o, days, "day", "_then").withColumn("_next", F.coalesce("_next", _best(F.col("below"), reach)["quarter"])).drop("below")
    o = looked_up(o, quarters, "quarter", "_next").withColumn("_hit", F.coalesce("_hit", met(_best(F.col("below"), reach))))
    return o.filter("_hit IS NOT NULL").select("_row.*", F.col("_hit.at").alias("executed_at"), F.col("_hit.mark").alias("executed_mark"))


def executions(triggered: DataFrame, lives: DataFrame) -> DataFrame:
    """What each triggered order does: open, close its position, or just be cleared.

    It closes a position of its own trader that is open when it fires, the one it ends included.
    """
    end = lambda c: F.col(f"ending.{c}")
    life = lives.select(F.col("id").alias("position_id"), F.col("trader").alias("_owner"), "opened_at", end("at").alias("_end"), end("kind").alias("_by"), end("ref").alias("_ref"))
    df = triggered.join(life, "position_id", "left")
    ends_it = (F.col("_by") == "order") & (F.col("_ref") == F.col("order_id"))
    live = (F.col("_owner") == F.col("trader")) & (F.col("opened_at") <= F.col("executed_at")) & (F.col("_end").isNull() | (F.col("executed_at") < F.col("_end")) | ends_it)
    action = F.when(F.col("kind") == "limit", "open").when(F.coalesce(live, F.lit(False)), "close").otherwise("clear")
    return df.withColumn("action", action).drop("_owner", "opened_at", "_end", "_by", "_ref")


def of_trader(rows: DataFrame, trader: str) -> DataFrame:
    """Rows of one trader, whatever the case of the address."""
    return rows.filter(F.lower("trader") == trader.lower())


def of_traders(rows: DataFrame, traders: DataFrame) -> DataFrame:
    """Rows of the given traders (column ``trader``), whatever the case."""
    wanted = traders.select(F.lower("trader").alias("_t")).distinct()
    return rows.withColumn("_t", F.lower("trader")).join(wanted, "_t", "left_semi").drop("_t")


def book_stats(open_rows: DataFrame) -> DataFrame:
    """Open positions, longs, shorts and total notional."""
    return open_rows.agg(
        F.count(F.lit(1)).alias("open_positions"),
        F.count_if("is_long").alias("longs"),
        F.count_if(~F.col("is_long")).alias("shorts"),
        F.coalesce(F.sum(notional()), wide(F.lit(0))).alias("reserved"),
    )


def vault_deltas(flows: DataFrame, book: DataFrame) -> DataFrame:
    """Every change of the vault's assets in one table (at, seq, kind, delta); amounts stay wide."""
    lp = flows.select(
        "at", "seq", F.col("event_type").alias("kind"),
        wide(F.when(F.col("event_type") == "deposit", F.col("assets")).otherwise(-F.col("assets"))).alias("delta"),
    )
    return lp.unionByName(book.select("at", "seq", "kind", F.col("assets").alias("delta")))


def vault_history(deltas: DataFrame, bucket_seconds: int = DAY) -> DataFrame:
    """Running total of vault assets after every change."""
    bucket = F.floor(F.col("at") / bucket_seconds)
    df = deltas.withColumn("_vault", F.lit("vault"))
    out = running(df, ["_vault"], ["at", "seq", "kind"], bucket, {"assets": ("sum", F.col("delta"))})
    return out.drop("_vault")


def vault_stats(assets: Column, supply: Column, reserved: Column) -> dict[str, Column]:
    """Available assets, share price and utilisation (percent, floored to basis points)."""
    a, s, r = wide(assets), wide(supply), wide(reserved)
    util = truncated_div(r * F.lit(BPS), a)
    return {
        "available": whole(F.greatest(a - r, wide(F.lit(0)))),
        "share_price": F.when(s > 0, assets.cast("double") / F.when(s > 0, supply.cast("double"))).otherwise(F.lit(1.0)),
        "utilization_pct": F.coalesce(util.cast("double") / F.lit(100.0), F.lit(0.0)),
    }


def to_shares(assets: Column, supply: Column, total: Column) -> Column:
    """Shares minted for ``assets``, floored; one to one into an empty vault, NULL if insolvent."""
    return F.when(supply == 0, wide(assets)).otherwise(mul_div(assets, supply, total))


def to_assets(shares: Column, supply: Column, total: Column) -> Column:
    """Assets redeemed for ``shares``, floored."""
    return F.when(supply == 0, wide(shares)).otherwise(mul_div(shares, total, supply))


def fee_report(tickets: DataFrame, settled: DataFrame) -> DataFrame:
    """Fees collected by kind: open, close, funding."""
    opens = tickets.filter(F.col("reject_reason").isNull()).select(F.lit("open").alias("kind"), whole(F.col("open_fee")).alias("amount"))
    ends = settled.select(
        F.inline(
            F.array(
                F.struct(F.lit("close").alias("kind"), whole(F.col("close_fee")).alias("amount")),
                F.struct(F.lit("funding").alias("kind"), whole(F.col("funding")).alias("amount")),
            )
        )
    )
    return opens.unionByName(ends).groupBy("kind").agg(F.count_if((F.col("kind") != "funding") | (F.col("amount") > 0)).alias("n"), F.sum("amount").alias("amount"))


def reserve_reconciliation(lives: DataFrame, book: DataFrame) -> DataFrame:
    """Check that the reserve which the book's changes leave equals the notional still open."""
    total = lambda c, keep: F.coalesce(wide(F.sum(F.when(keep, c))), wide(F.lit(0)))
    moved = book.agg(total(F.col("reserved"), F.col("reserved") > 0).alias("reserved"), total(-F.col("reserved"), F.col("reserved") < 0).alias("released"))
    still = open_positions(lives).agg(total(notional(), F.lit(True)).alias("open_notional"))
    # One row each.
    out = moved.withColumn("_k", F.lit(1)).join(F.broadcast(still.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return out.withColumn("balanced", F.col("reserved") - F.col("released") == F.col("open_notional"))


def lp_claims(balances: DataFrame, totals: DataFrame) -> DataFrame:
    """Check that what all holders could redeem, each floored, stays within the vault's assets.

    ``balances`` holds one row per holder with its ``shares``; ``totals`` is one row (supply, assets).
    """
    one = F.broadcast(totals.select(F.lit(1).alias("_k"), wide(F.col("supply")).alias("supply"), wide(F.col("assets")).alias("assets")))
    held = balances.withColumn("_k", F.lit(1)).join(one, "_k")
    held = held.withColumn("_claim", to_assets(F.col("shares"), F.col("supply"), F.col("assets")))
    out = held.agg(F.count(F.lit(1)).alias("holders"), wide(F.sum("_claim")).alias("claims"), F.max("assets").alias("assets"), F.max("supply").alias("supply"))
    return out.withColumn("within", F.col("claims") <= F.col("assets"))

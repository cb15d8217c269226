"""Which polls of an index pair are worth publishing on-chain.

A poll is emitted first of all, then whenever either value moved enough against the last
*emitted* pair, or the last emission is too old. Polls happen at a fixed cadence, also while
nothing moves, so a heartbeat falls due in quiet stretches too.

That is a walk: each emission decides the next. The walk is cut into chunks of time. The last
emission before a chunk is either one of the few polls within a heartbeat of the chunk, or so
old that the chunk's first poll is emitted whatever it was. So each chunk is solved for those
few entries in parallel, which gives a table from entry to exit. Tables compose: ``FAN``
neighbours become one table of their group, groups become tables of larger groups, and the
way back down hands every group, then every chunk, the state it is entered with. The chunks
then emit their rows in parallel. No task sees more than one chunk of polls, or the tables of
one group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.operators.ordered import running
from varstrip.params import ThinningConfig

# Chunks of a day: 32^3 of them are ninety years, so the last table joins a few groups.
FAN, LEVELS = 32, 3
TABLE = "chunk bigint, entry_at bigint, at bigint, a bigint, b bigint"


def poll_pairs(marks: DataFrame, first: str, second: str, poll_seconds: int = 60, bucket_seconds: int = 86_400) -> DataFrame:
    """Latest marks of two indices at every poll from the first mark to the poll after the last.

    ``marks`` holds index_id, at (seconds), seq and mark. A side without a new mark keeps its
    latest one; polls before both sides are known are absent.
    """
    poll = (F.floor(F.col("at") / poll_seconds) + 1) * poll_seconds
    last = F.struct("at", "seq", "mark")

    def side(index_id: str):
        return F.max(F.when(F.col("index_id") == index_id, last))

    polls = marks.withColumn("_poll", poll).groupBy("_poll").agg(side(first).alias("_a"), side(second).alias("_b"))
    # Quiet polls: one row with the ends, cut into buckets, filled where the buckets lie.
    ends = marks.agg(F.min(poll).alias("_low"), F.max(poll).alias("_high")).filter("_low IS NOT NULL")
    low = lambda b: F.ceil(b * bucket_seconds / poll_seconds) * poll_seconds
    bucket = lambda c: F.floor(c / bucket_seconds)
    pieces = ends.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high"))))).repartition("_bucket")
    start = F.greatest("_low", low(F.col("_bucket")))
    end = F.least(F.col("_high"), low(F.col("_bucket") + 1) - poll_seconds)
    quiet = pieces.filter(start <= end).select(F.explode(F.sequence(start, end, F.lit(poll_seconds).cast("bigint"))).alias("_poll"))
    none = F.lit(None).cast(polls.schema["_a"].dataType)
    every = polls.unionByName(quiet.select("_poll", none.alias("_a"), none.alias("_b")))
    every = every.groupBy("_poll").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")).withColumn("_pair", F.lit("pair"))
    known = running(every, ["_pair"], ["_poll"], bucket(F.col("_poll")), {"a": ("max", F.col("_a")), "b": ("max", F.col("_b"))})
    pairs = known.select(F.col("_poll").alias("at"), F.col("a.mark").alias("a"), F.col("b.mark").alias("b"))
    return pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def reason_to_emit(state, at: int, a: int, b: int, bps: int, heartbeat: int) -> str | None:
    """Why a poll is emitted given the last emitted (at, a, b), or None."""
    if state is None:
        return "init"
    for new, old in ((a, state[1]), (b, state[2])):
        if old and abs(new - old) * 10_000 // old >= bps:
            return "deviation"
    return "heartbeat" if at - state[0] >= heartbeat else None


def _walk(state, rows: list[tuple], start: int, bps: int, heartbeat: int):
    """Yield (row number, reason) of every emission from ``start`` on."""
    for i in range(start, len(rows)):
        why = reason_to_emit(state, *rows[i], bps, heartbeat)
        if why:
            state = rows[i]
            yield i, why


def _rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame.sort_values("at")
    return list(zip(ordered["at"].tolist(), ordered["a"].tolist(), ordered["b"].tolist()))


def _state(at, a, b) -> tuple | None:
    return None if pd.isna(at) else (int(at), int(a), int(b))


def _tables(frame: pd.DataFrame) -> list[tuple[int, dict]]:
    """Chunks in order, each with its table: time of the last emission (None: any older one) to the state it leaves."""
    out: dict[int, dict] = {}
    for chunk, entry, *leave in frame[["chunk", "entry_at", "at", "a", "b"]].sort_values("chunk").itertuples(index=False):
        out.setdefault(int(chunk), {})[None if pd.isna(entry) else int(entry)] = _state(*leave)
    return sorted(out.items())


def _through(state, table: dict):
    return table.get(state and state[0], table[None])


def _composed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The table of a group of chunks: entries of its first one, exits of its last one."""
    (_, first), *rest = _tables(frame)
    out = []
    for entry, state in first.items():
        for _, table in rest:
            state = _through(state, table)
        out.append((key[0], entry, *state))
    return pd.DataFrame(out, columns=["chunk", "entry_at", "at", "a", "b"]).astype({"entry_at": "Int64"})


def _handed_down(tables: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
    """The state that each chunk of a group is entered with, given the group's."""
    state = _state(*entry[["at", "a", "b"]].iloc[0]) if len(entry) else None
    out = []
    for chunk, table in _tables(tables):
        out.append((chunk, *(state or (None, None, None))))
        state = _through(state, table)
    return pd.DataFrame(out, columns=["chunk", "at", "a", "b"]).astype({c: "Int64" for c in ("at", "a", "b")})


def entry_states(tables: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(chunk, at, a, b): the last emission before each chunk, NULL before the first one.

    ``tables`` are the chunks' own (``TABLE``); ``levels`` times, ``fan`` neighbours are composed.
    """
    group = F.floor(F.col("chunk") / fan).alias("group")
    up = [tables]
    for _ in range(levels):
        up.append(up[-1].groupBy(group).applyInPandas(_composed, TABLE))
    # Above the last level all groups have one parent, which is entered with nothing.
    parent = F.lit(0).cast("bigint")
    top = up[-1].select(parent.alias("chunk")).distinct().select("chunk", *[F.lit(None).cast("bigint").alias(c) for c in ("at", "a", "b")])
    entered = top
    for own in reversed(up):
        key = parent.alias("group") if entered is top else group
        entered = own.groupBy(key).cogroup(entered.groupBy("chunk")).applyInPandas(_handed_down, "chunk bigint, at bigint, a bigint, b bigint")
    return entered


def thin(pairs: DataFrame, config: ThinningConfig = ThinningConfig(), chunk_seconds: int = 86_400) -> DataFrame:
    """Emitted polls (at, a, b, reason). Polls with a zero side are skipped altogether."""
    bps, heartbeat = config.deviation_bps, config.heartbeat_seconds
    polls = pairs.filter((F.col("a") != 0) & (F.col("b") != 0)).withColumn("chunk", F.floor(F.col("at") / chunk_seconds))

    # A poll can be the last emission before the chunks that begin within a heartbeat of it.
    reached = F.floor((F.col("at") + heartbeat) / chunk_seconds)
    later = F.when(reached > F.col("chunk"), F.sequence(F.col("chunk") + 1, reached))
    entry_rows = polls.select(F.explode(later).alias("at_chunk"), *[F.col(c).alias(f"e_{c}") for c in ("at", "a", "b")])

    def solve(key: tuple, rows_pdf: pd.DataFrame, entry_pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(rows_pdf)
        columns = ["chunk", "entry_at", "at", "a", "b"]
        if not rows:
            return pd.DataFrame(columns=columns)
        exits: dict[int, int] = {}

        def exit_from(i: int) -> int:
            path, j = [i], i
            while j not in exits:
                nxt = next(_walk(rows[j], rows, j + 1, bps, heartbeat), None)
                if nxt is None:
                    exits[j] = j
                    break
                j = nxt[0]
                path.append(j)
            for p in path:
                exits[p] = exits[j]
            return exits[i]

        # None stands for any older emission: the first poll is then emitted in any case.
        out = []
        for state in [None, *_rows(entry_pdf.rename(columns=lambda c: c.removeprefix("e_")))]:
            first = next(_walk(state, rows, 0, bps, heartbeat), None)
            leave = state if first is None else rows[exit_from(first[0])]
            out.append((key[0], state and state[0], *leave))
        return pd.DataFrame(out, columns=columns).astype({"entry_at": "Int64"})

    solved = polls.groupBy("chunk").cogroup(entry_rows.groupBy("at_chunk")).applyInPandas(solve, TABLE)
    entered = entry_states(solved)

    def emit(rows_pdf: pd.DataFrame, entry_pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _rows(rows_pdf)
        state = _state(*entry_pdf[["at", "a", "b"]].iloc[0])
        out = [(*rows[i], why) for i, why in _walk(state, rows, 0, bps, heartbeat)]
        return pd.DataFrame(out, columns=["at", "a", "b", "reason"])

    return polls.groupBy("chunk").cogroup(entered.groupBy("chunk")).applyInPandas(emit, "at bigint, a bigint, b bigint, reason string")

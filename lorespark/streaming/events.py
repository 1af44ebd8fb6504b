"""Event logs folded into keyed state, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout



def clamped(rows: DataFrame, by: str, ts: str, delta: str, start: int, low: int, high: int) -> DataFrame:
    """Per key the balance after its deltas in order, held between low and high at each step; ties in time by delta."""
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(ts, delta))).alias("all"))
    fold = F.aggregate("all", F.lit(start).cast("bigint"), lambda acc, x: F.greatest(F.lit(low).cast("bigint"), F.least(F.lit(high).cast("bigint"), acc + x[delta])))
    return lists.select(by, fold.alias("balance"), F.size("all").alias("n_events"))


def status(rows: DataFrame, by: str, ts: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per key: whether each kind of event has happened, and the last event."""
    flags = [F.max((F.col(kind) == k).cast("int")).cast("boolean").alias(f"has_{k}") for k in kinds]
    last = F.max_by(F.struct(kind, ts), F.struct(ts, kind))
    return rows.groupBy(by).agg(*flags, last.alias("l")).select(by, *[f"has_{k}" for k in kinds], F.col(f"l.{kind}").alias("last_type"), F.col(f"l.{ts}").alias("last_ts"))


def counts_by_type(rows: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """Events per type, with zero for the types that have none."""
    seen = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(seen, kind, "left").select(kind, F.coalesce("n", F.lit(0)).alias("n"))


def windowed(rows: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """Events per type and window; on a stream, windows close after the lateness allowed."""
    return rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def clamped_stream(rows: DataFrame, by: str, ts: str, delta: str, start: int, low: int, high: int) -> DataFrame:
    """clamped() on a stream in arrival order: the balance of each key that got events, at each trigger.

    Events are in order of time within a trigger only: one that comes late is
    folded when it comes, so the balance may differ from that of clamped().
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        balance, n = state.get if state.exists else (start, 0)
        events = pd.concat(list(batches)).sort_values([ts, delta])
        for d in events[delta]:
            balance, n = max(low, min(high, balance + int(d))), n + 1
        state.update((balance, n))
        yield pd.DataFrame({by: [key[0]], "balance": [balance], "n_events": [n]})

    return rows.select(by, ts, delta).groupBy(by).applyInPandasWithState(step, f"{by} bigint, balance bigint, n_events int", "balance bigint, n_events int", "update", GroupStateTimeout.NoTimeout)


def unit_status(events: DataFrame) -> DataFrame:
    """Per game and unit its status after all events (columns of schemas.EVENTS): the last move decides how it
    moved, the last test whether it is shaken; shooting, a successful charge, fighting and destruction stay."""
    last = lambda kind, value: F.max_by(F.when(F.col("type") == kind, value), F.when(F.col("type") == kind, F.struct("ts", "id")))
    ever = lambda cond: F.coalesce(F.max(cond.cast("int")), F.lit(0)).cast("boolean")
    is_ = lambda kind: F.col("type") == kind
    gone = F.min_by(F.struct("ts", "round"), F.when(is_("unit_destroyed"), F.struct(-F.col("ts"), "id")))
    return (
        events.filter("unit_id is not null")
        .groupBy("game_id", "unit_id")
        .agg(
            F.coalesce(last("unit_moved", F.col("text") == "advance"), F.lit(False)).alias("advanced"),
            F.coalesce(last("unit_moved", F.col("text") == "fall_back"), F.lit(False)).alias("fell_back"),
            ever(is_("unit_shot")).alias("has_shot"),
            ever(is_("unit_charged") & F.col("flag")).alias("has_charged"),
            ever(is_("unit_fought")).alias("has_fought"),
            F.coalesce(last("battleshock_test", ~F.col("flag")), F.lit(False)).alias("battle_shocked"),
            ever(is_("unit_destroyed")).alias("destroyed"),
            F.when(ever(is_("unit_destroyed")), gone).alias("g"),
        )
        .select("*", F.col("g.ts").alias("destroyed_at"), F.col("g.round").alias("destroyed_round"))
        .drop("g")
    )


def owners(events: DataFrame) -> DataFrame:
    """Per game and objective (text) the player who took it last, and when."""
    took = events.filter("type = 'objective_taken'")
    return took.groupBy("game_id", F.col("text").alias("objective")).agg(F.max_by("player", F.struct("ts", "id")).alias("player"), F.max("ts").alias("since"))


# The phases of a turn in order.
PHASE_ORDER = ["command", "movement", "shooting", "charge", "fight", "scoring"]


def turns(events: DataFrame) -> DataFrame:
    """Events of type next_phase with the phase, player and round that each leads to, from the first command phase on."""
    from pyspark.sql import Window

    w = Window.partitionBy("game_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    order = F.array(*[F.lit(p) for p in PHASE_ORDER])
    return events.filter("type = 'next_phase'").select("game_id", "id", "ts", n.alias("n")).select("game_id", "id", "ts", F.element_at(order, (F.col("n") % len(PHASE_ORDER) + 1).cast("int")).alias("phase"), (F.floor(F.col("n") / len(PHASE_ORDER)) % 2).cast("int").alias("player"), (F.floor(F.col("n") / (2 * len(PHASE_ORDER))) + 1).cast("int").alias("round")).filter("round <= 5")

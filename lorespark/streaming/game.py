"""A game's log folded into its state: legal events, unit flags by turn, cards, scores, eligibility.

Logs are walked in order with a state of a few values, so a game may have any
number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.walks import fold, walk
from lorespark.streaming.events import PHASE_ORDER

# Events that a phase accepts; moving on is legal in all but the last, ending the turn in the last.
LEGAL = {
    "command": ["battleshock_test", "stratagem_used"],
    "movement": ["unit_moved", "stratagem_used"],
    "shooting": ["unit_shot", "unit_destroyed", "stratagem_used"],
    "charge": ["unit_charged", "stratagem_used"],
    "fight": ["unit_fought", "unit_destroyed", "stratagem_used"],
    "scoring": ["score_points"],
}
ROUNDS, HAND, MOST_CP = 5, 2, 12


def legal_events(events: DataFrame) -> DataFrame:
    """Events (game_id, id, ts, type, ...) that the game accepts where they stand, with the phase, player (0, 1) and round of that moment.

    next_phase leads on up to scoring, end_turn from scoring to the other
    player's command phase and, after the second one, to the next round, the
    fifth at most. Events that are not legal in their phase are left out.
    """
    last = len(PHASE_ORDER) - 1

    def step(state: tuple[int, int, int], row: tuple) -> tuple:
        (phase, player, round_), (kind,) = state, row
        here = PHASE_ORDER[phase], player, round_
        if kind == "end_turn" and phase == last:
            return (0, 1 - player, min(round_ + player, ROUNDS)), here
        if kind == "next_phase" and phase < last:
            return (phase + 1, player, round_), here
        return state, here if kind in LEGAL[PHASE_ORDER[phase]] else None

    return walk(events, ["game_id"], ["ts", "id"], ["type"], lambda: (0, 0, 1), step, "in_phase string, in_player int, in_round int")


def turn_flags(events: DataFrame) -> DataFrame:
    """Per game and unit what it did since the last end of a turn: advanced, fell_back, has_shot, has_charged, has_fought."""
    w = Window.partitionBy("game_id").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumn("_turn", F.count_if(F.col("type") == "end_turn").over(w))
    now = numbered.withColumn("_now", F.max("_turn").over(Window.partitionBy("game_id")))
    this = now.filter("unit_id is not null").withColumn("_in", F.col("_turn") == F.col("_now"))
    did = lambda cond: F.coalesce(F.max(F.col("_in") & cond), F.lit(False))
    is_ = lambda kind: F.col("type") == kind
    last = F.max_by("text", F.when(F.col("_in") & is_("unit_moved"), F.struct("ts", "id")))
    flags = this.groupBy("game_id", "unit_id").agg(last.alias("_move"), did(is_("unit_shot")).alias("has_shot"), did(is_("unit_charged") & F.coalesce("flag", F.lit(False))).alias("has_charged"), did(is_("unit_fought")).alias("has_fought"))
    moved = lambda how: F.coalesce(F.col("_move") == how, F.lit(False)).alias({"advance": "advanced", "fall_back": "fell_back"}[how])
    return flags.select("game_id", "unit_id", moved("advance"), moved("fall_back"), "has_shot", "has_charged", "has_fought")


def card_hands(events: DataFrame, deck: int, start_cp: int = 6) -> DataFrame:
    """Per game and player the hand, cards left in the deck, discarded and achieved cards, command and victory points.

    events: game_id, player, ts, id, type (draw, discard, achieve), card,
    amount (points scored), flag (a discard that gains a command point, twelve
    at most in hand). A draw needs a hand of fewer than two. The log is walked
    in order, so its time grows with the events; only a player's own cards,
    which the row returns, are held.
    """
    told = events.select("game_id", "player", "ts", "id", "type", "card", F.coalesce("amount", F.lit(0)).alias("amount"), F.coalesce("flag", F.lit(False)).alias("flag"))

    def step(state: list, row: tuple) -> list:
        hand, left, discarded, achieved, cp, vp = state
        kind, card, amount, flag = row
        if kind == "draw" and len(hand) < HAND:
            return [[*hand, card], max(0, left - 1), discarded, achieved, cp, vp]
        if kind not in ("discard", "achieve"):
            return state
        # As in SQL, nothing is known to differ from a card that is null.
        hand = [c for c in hand if c is not None and card is not None and c != card]
        (discarded if kind == "discard" else achieved).append(card)
        if kind == "achieve":
            return [hand, left, discarded, achieved, cp, vp + amount]
        return [hand, left, discarded, achieved, min(MOST_CP, cp + 1) if flag else cp, vp]

    order = ["ts", "id", "type", "card", "amount", "flag"]
    shape = "hand array<string>, deck int, discarded array<string>, achieved array<string>, cp int, vp int"
    return fold(told, ["game_id", "player"], order, ["type", "card", "amount", "flag"], lambda: [[], deck, [], [], start_cp, 0], step, tuple, shape)


def scores(events: DataFrame) -> DataFrame:
    """(game_id, player, primary, secondary, total, challenger_used): points by kind (primary, secondary, and a challenger's mission, which counts as secondary)."""
    part = lambda *kinds: F.coalesce(F.sum(F.when(F.col("type").isin(*kinds), F.coalesce("amount", F.lit(0)))), F.lit(0)).cast("bigint")
    out = events.groupBy("game_id", "player").agg(part("score_primary").alias("primary"), part("achieve", "use_challenger").alias("secondary"), F.max(F.col("type") == "use_challenger").alias("challenger_used"))
    return out.withColumn("total", F.col("primary") + F.col("secondary"))


def eligible_challengers(table: DataFrame, decks: DataFrame, threshold: int) -> DataFrame:
    """(game_id, player) of scores() that trail the other one by the threshold, have used no challenger, in games (game_id, cards_left) whose deck has cards."""
    other = table.select("game_id", (1 - F.col("player")).alias("player"), F.col("total").alias("theirs"))
    met = table.join(other, ["game_id", "player"]).join(decks.filter("cards_left > 0").select("game_id"), "game_id", "left_semi")
    return met.filter((F.col("theirs") - F.col("total") >= threshold) & ~F.col("challenger_used")).select("game_id", "player")


def by_round(events: DataFrame) -> DataFrame:
    """(game_id, round, ids): events of each round from 1 to 5, in order; empty for rounds without any."""
    rounds = events.select("game_id").distinct().select("game_id", F.explode(F.sequence(F.lit(1), F.lit(ROUNDS))).alias("round"))
    lists = events.groupBy("game_id", "round").agg(F.array_sort(F.collect_list(F.struct("ts", "id"))).alias("all"))
    return rounds.join(lists, ["game_id", "round"], "left").select("game_id", "round", F.coalesce(F.transform("all", lambda x: x["id"]), F.array().cast("array<string>")).alias("ids"))


def player_summary(units: DataFrame, points: DataFrame) -> DataFrame:
    """(game_id, player, remaining, lost, points_lost) of units (game_id, player, name, destroyed); points: name, points, missing ones count 0."""
    priced = units.join(points.groupBy("name").agg(F.max("points").alias("points")), "name", "left")
    lost = F.coalesce("destroyed", F.lit(False))
    return priced.groupBy("game_id", "player").agg(F.count_if(~lost).alias("remaining"), F.count_if(lost).alias("lost"), F.coalesce(F.sum(F.when(lost, F.coalesce("points", F.lit(0)))), F.lit(0)).cast("bigint").alias("points_lost"))


def initial_state(reports: DataFrame) -> DataFrame:
    """Units of reports (game_id, units: array of name, player, wounds) as the game starts: an id each, full wounds, nothing done."""
    each = reports.select("game_id", F.posexplode("units").alias("at", "u"))
    return each.select("game_id", F.concat_ws("-", F.lit("unit"), "at").alias("unit_id"), F.col("u.name").alias("name"), F.col("u.player").alias("player"), F.col("u.wounds").alias("max_wounds"), F.col("u.wounds").alias("wounds"), F.lit(False).alias("destroyed"))


def fan_out(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, workers: int = 3) -> DataFrame:
    """work() over rows in so many partitions at once, with a column error: null, or, in the one row that a batch gives whose work fails, what went wrong; the other batches give theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield work(batch).assign(error=None)
            except Exception as e:  # noqa: BLE001  a worker's failure is its batch's
                yield pd.DataFrame({"error": [f"{type(e).__name__}: {e}"[:1000]]}).reindex(columns=[*names, "error"])

    names = [c.strip().split()[0] for c in schema.split(",")]
    return rows.repartition(workers).mapInPandas(run, f"{schema}, error string")


def live_mentions(captions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions in a stream of captions (video_id, seq, text), each trigger's by themselves; as detect_mentions() finds them in a table."""
    from lorespark.operators.match import detect_mentions

    return detect_mentions(captions.select("video_id", "seq", "text"), dictionary, ["video_id", "seq"])

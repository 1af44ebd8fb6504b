"""Streams folded in the order of their events, whenever these arrive.

Events wait in their key's state until the watermark has passed them, and are
then folded in order, so that a stream gives what the same rows give as a
table. A key's state holds its fold and the events of the time that the
watermark allows for; a timer wakes keys that get no more events.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorespark.operators.phrases import automaton, held, spans


def ordered_fold(rows: DataFrame, by: str, ts: str, columns: list[str], late: str, start: tuple, step: Callable[[tuple, tuple], tuple], shape: str) -> DataFrame:
    """(by, shape..., n_events, until): each key's fold as of the watermark, whenever it has moved on.

    rows: a stream with by (bigint), ts (timestamp) and columns of numbers,
    texts or truth values. step takes the state so far, start at first, and
    (ts in microseconds, columns...) of an event, in order of these, nulls
    first; it returns the next state, of the types of shape. until is the time
    of the last event folded. Events that come later than ``late`` allows are
    dropped by the watermark, rows without a key or a time are left out.
    """
    names = [c.strip().split()[0] for c in shape.split(",")]
    sortable = lambda event: tuple((x is not None, x) for x in event)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        folded, n, until, waiting = json.loads(state.get[0]) if state.exists else (list(start), 0, None, [])
        if not state.hasTimedOut:
            for batch in batches:
                waiting += [[None if pd.isna(x) else x for x in event] for event in batch[["_at", *columns]].astype(object).values.tolist()]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=sortable)
        ready = [e for e in waiting if e[0] <= mark]
        waiting = waiting[len(ready) :]
        for event in ready:
            folded, n, until = list(step(tuple(folded), tuple(event))), n + 1, event[0]
        state.update((json.dumps([folded, n, until, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, mark // 1000 + 1))
        if ready:
            yield pd.DataFrame({by: [key[0]], **{c: [x] for c, x in zip(names, folded, strict=True)}, "n_events": [n], "until": [pd.Timestamp(until, unit="us")]})

    timed = rows.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late).select(by, ts, F.unix_micros(ts).alias("_at"), *columns)
    return timed.groupBy(by).applyInPandasWithState(run, f"{by} bigint, {shape}, n_events bigint, until timestamp", "held string", "update", GroupStateTimeout.EventTimeTimeout)


def clamped_in_order(rows: DataFrame, by: str, ts: str, delta: str, start: int, low: int, high: int, late: str) -> DataFrame:
    """events.clamped() of a stream: (by, balance, n_events, until), late events folded in their place."""
    return ordered_fold(rows, by, ts, [delta], late, (start,), lambda state, e: (max(low, min(high, state[0] + int(e[1] or 0))),), "balance bigint")


def mention_changes(captions: DataFrame, dictionary: DataFrame, ts: str, late: str) -> DataFrame:
    """(video_id, seq, start, phrase, change): mentions that come (1) and go (-1) as the captions of a stream grow or are put right.

    captions: video_id, seq, text, ts. A segment's state is what its last text
    (by ts, then text) mentions; the changes of a segment add up to the
    mentions of its last text, as phrases.find_phrases() finds them in a table.
    A text that is older than the last one changes nothing. The state of a
    segment goes once the watermark has passed its last text.
    """
    shared = captions.sparkSession.sparkContext.broadcast(held(dictionary, []))
    version = str(hash(tuple(shared.value)))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, text, known = json.loads(state.get[0]) if state.exists else (None, None, [])
        last = max((int(a), t or "") for batch in batches for a, t in zip(batch["_at"], batch["text"], strict=True))
        if at is not None and last <= (at, text):
            return
        built = automaton(shared.value, version)
        now = [[a, row[0]] for a, _, row in spans(last[1], built)] if len(built) else []
        changes = [(*m, -1) for m in known if m not in now] + [(*m, 1) for m in now if m not in known]
        state.update((json.dumps([last[0], last[1], now]),))
        state.setTimeoutTimestamp(max(last[0] // 1000, state.getCurrentWatermarkMs()) + 1)
        if changes:
            yield pd.DataFrame({"video_id": key[0], "seq": key[1], "start": [c[0] for c in changes], "phrase": [c[1] for c in changes], "change": [c[2] for c in changes]})

    timed = captions.withWatermark(ts, late).select("video_id", "seq", "text", ts, F.unix_micros(ts).alias("_at"))
    shape = "video_id bigint, seq int, start int, phrase string, change int"
    return timed.groupBy("video_id", "seq").applyInPandasWithState(run, shape, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def interval_join(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, before: str, after: str, late: str) -> DataFrame:
    """Pairs of events of two streams with one key, the right one at most ``before`` earlier and ``after`` later than the left one.

    Both sides have watermarks and the condition bounds their distance, so
    Spark drops an event once nothing that may still come can meet it. The
    columns of the two sides have different names but for ``by``.
    """
    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    near = F.expr(f"b.{right_ts} >= a.{left_ts} - interval {before} and b.{right_ts} <= a.{left_ts} + interval {after}")
    return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & near).drop(F.col(f"b.{by}"))

"""Streams against the same rows as tables: ordered folds, captions, joins, sinks and sources."""

import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorespark.operators import phrases
from lorespark.schemas import EVENTS
from lorespark.sources.files import Captions, EventLog, caption_rows
from lorespark.streaming import events as ev
from lorespark.streaming import ordered, sinks

BEGIN = datetime(2024, 1, 1)


def streamed(spark, df, parts, tmp_path, name):
    """df as a stream of one file a trigger, its rows dealt out in the order they have."""
    rows = df.collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def told(stream, tmp_path, name, mode="append"):
    """All rows that a stream gives, in batches."""
    out = []
    each = lambda batch, n: out.extend((n, r) for r in batch.collect())
    stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()
    return out


def test_late_events_are_folded_in_order(spark, tmp_path):
    rng = random.Random(1)
    # Times repeat, and one key has a hundred times the rows of the others.
    rows = [(1 if rng.random() < 0.9 else rng.randrange(2, 8), BEGIN + timedelta(seconds=rng.randrange(3000)), rng.choice([-5, -2, 1, 4])) for _ in range(600)]
    df = spark.createDataFrame([*rows, (99, BEGIN + timedelta(days=9), 0)], "k bigint, ts timestamp, d int")
    stream = ordered.clamped_in_order(streamed(spark, df, 4, tmp_path, "in"), "k", "ts", "d", 6, 0, 12, "2 hours")
    last = {r["k"]: (r["balance"], r["n_events"]) for _, r in told(stream, tmp_path, "a", "update")}
    want = {r["k"]: (r["balance"], r["n_events"]) for r in ev.clamped(df.filter("k < 99"), "k", "ts", "d", 6, 0, 12).collect()}
    assert last == want
    shuffled = sorted(df.filter("k < 99").collect(), key=lambda r: rng.random()) + df.filter("k = 99").collect()
    again = ordered.clamped_in_order(streamed(spark, spark.createDataFrame(shuffled, df.schema), 3, tmp_path, "again"), "k", "ts", "d", 6, 0, 12, "2 hours")
    assert {r["k"]: (r["balance"], r["n_events"]) for _, r in told(again, tmp_path, "b", "update")} == want


def test_any_fold_in_order(spark, tmp_path):
    """Cards in hand: drawn and played, with texts, truth values and nulls in the events."""
    rows = [(1, BEGIN + timedelta(seconds=s), c, b) for s, c, b in [(5, "b", True), (1, "a", True), (3, "a", False), (2, None, None), (9, "c", True)]] + [(2, BEGIN + timedelta(days=3), "z", True), (None, BEGIN, "q", True), (3, None, "q", True)]
    df = spark.createDataFrame(rows, "k bigint, ts timestamp, card string, drawn boolean")
    hand = lambda state, e: (state[0] + e[1] if e[2] else state[0].replace(e[1] or "?", ""), state[1] or e[1] is None)
    stream = ordered.ordered_fold(streamed(spark, df, 2, tmp_path, "in"), "k", "ts", ["card", "drawn"], "1 day", ("", False), hand, "hand string, odd boolean")
    got = [r for _, r in told(stream, tmp_path, "a", "update") if r["k"] == 1]
    assert (got[-1]["hand"], got[-1]["odd"], got[-1]["n_events"], got[-1]["until"]) == ("bc", True, 5, BEGIN + timedelta(seconds=9))


def test_changes_of_captions_add_up_to_the_last_text(spark, tmp_path):
    d = spark.createDataFrame([("red bolt",), ("bolt",), ("blue rod",)], "phrase string")
    grow = [(1, 1, "a red", 1), (1, 1, "a red bolt", 2), (1, 1, "a red bolt and blue rod", 3), (1, 2, "bolt", 1), (1, 2, None, 2), (2, 1, "blue rod", 5), (2, 1, "old bolt", 4), (2, 2, "bolt bolt", 3)]
    df = spark.createDataFrame([(v, s, t, BEGIN + timedelta(seconds=x)) for v, s, t, x in grow], "video_id bigint, seq int, text string, ts timestamp")
    got = told(ordered.mention_changes(streamed(spark, df, 8, tmp_path, "in"), d, "ts", "1 hour"), tmp_path, "a")
    total = {}
    for _, r in got:
        key = (r["video_id"], r["seq"], r["start"], r["phrase"])
        total[key] = total.get(key, 0) + r["change"]
    last = spark.createDataFrame([(1, 1, "a red bolt and blue rod"), (1, 2, ""), (2, 1, "blue rod"), (2, 2, "bolt bolt")], "video_id bigint, seq int, text string")
    want = {(r["video_id"], r["seq"], h["start"], h["phrase"]): 1 for r in phrases.find_phrases(last, d).collect() for h in r["hits"]}
    assert {k: n for k, n in total.items() if n} == want and set(total.values()) <= {0, 1}
    assert total[1, 2, 0, "bolt"] == 0


def test_interval_join_of_streams(spark, tmp_path):
    rng = random.Random(2)
    side = lambda n, t: [(rng.randrange(4), BEGIN + timedelta(seconds=rng.randrange(2000)), f"{t}{i}") for i in range(n)]
    left, right = (spark.createDataFrame(side(80, t), f"k int, {t}_ts timestamp, {t}_id string") for t in "lr")
    near = F.expr("r_ts >= l_ts - interval 30 seconds and r_ts <= l_ts + interval 60 seconds")
    want = sorted((r["l_id"], r["r_id"]) for r in left.join(right, "k").filter(near).collect())
    joined = ordered.interval_join(streamed(spark, left, 3, tmp_path, "l"), streamed(spark, right, 2, tmp_path, "r"), "k", "l_ts", "r_ts", "30 seconds", "60 seconds", "1 hour")
    got = told(joined, tmp_path, "a")
    assert sorted((r["l_id"], r["r_id"]) for _, r in got) == want and len(want) > 50
    assert joined.columns.count("k") == 1


def test_sinks_give_one_table_however_often_a_batch_comes(spark, tmp_path):
    shape = "k int, v int, at int"
    batches = [[(i, i, 0) for i in range(40)], [(3, 30, 1), (41, 41, 1), (3, 31, 2)], [(41, 7, 0), (50, 1, 3)], []]
    order = [F.col("at").desc(), F.col("v").desc()]
    frames = [spark.createDataFrame(b, shape) for b in batches]
    state = {}
    for b in batches:
        for k, v, at in b:
            state[k] = max(state.get(k, (-1, -1)), (at, v))
    path = str(tmp_path / "t")
    sink = sinks.table_sink(path, ["k"], sinks.upserted(["k"], order), 8)
    assert sinks.read(spark, path, shape).count() == 0 and sinks.last_batch(spark, path) == -1
    for n, df in enumerate(frames):
        sink(df, n)
        sink(df, n)
    sink(spark.createDataFrame([(3, 99, 99)], shape), 1)
    assert {r["k"]: (r["at"], r["v"]) for r in sinks.read(spark, path, shape).collect()} == state
    assert sinks.last_batch(spark, path) == 3
    # A batch that was written but not noted comes again.
    sinks.merge_into(frames[1], path, ["k"], sinks.upserted(["k"], order), 8)
    assert {r["k"]: (r["at"], r["v"]) for r in sinks.read(spark, path, shape).collect()} == state


def test_sinks_touch_only_their_buckets(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k int, v int"
    first = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.startswith("part-")}
    sinks.table_sink(path, ["k"], sinks.inserted(["k"], ["v"]), 16)(spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v")), 0)
    before = first()
    sinks.table_sink(path, ["k"], sinks.inserted(["k"], ["v"]), 16)(spark.createDataFrame([(5, 2), (1000, 9), (1000, 3)], shape), 1)
    after = first()
    assert len(before.keys() & after.keys()) >= 13
    rows = {r["k"]: r["v"] for r in sinks.read(spark, path, shape).collect()}
    assert len(rows) == 201 and rows[5] == 1 and rows[1000] == 3
    links = str(tmp_path / "links")
    replace = sinks.table_sink(links, ["p"], sinks.replaced("p"), 4)
    replace(spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "p int, c int"), 0)
    replace(spark.createDataFrame([(1, 9)], "p int, c int"), 1)
    assert sorted(map(tuple, sinks.read(spark, links, "p int, c int").collect())) == [(1, 9), (2, 3)]


VTT = "WEBVTT\n\n1\n00:01.000 --> 00:02.500 align:start\nHello\nthere\n\nNOTE no cue\n\n01:00:00.250 --> 01:00:01.000\nlate\n\nbad --> time\nx\n"


def test_caption_and_event_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "e").mkdir()
    (tmp_path / "v/a.vtt").write_text(VTT)
    assert [r[1:] for r in caption_rows(str(tmp_path / "v/a.vtt"))] == [(0, 1.0, 2.5, "Hello there"), (1, 3600.25, 3601.0, "late")]
    spark.dataSource.register(Captions)
    spark.dataSource.register(EventLog)
    (tmp_path / "v/b.vtt").write_text("WEBVTT\n\n00:05.000 --> 00:06.000\nb\n")
    (tmp_path / "v/other.txt").write_text(VTT)
    got = spark.read.format("captions").load(str(tmp_path / "v"))
    assert sorted((os.path.basename(r["file"]), r["seq"], r["text"]) for r in got.collect()) == [("a.vtt", 0, "Hello there"), ("a.vtt", 1, "late"), ("b.vtt", 0, "b")]
    assert got.rdd.getNumPartitions() == 2
    rows = [{"id": f"e{i}", "game_id": 1, "ts": i, "type": "x", "flag": True, "amount": i} for i in range(5)]
    (tmp_path / "e/1.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nno json\n[1]\n")
    log = spark.read.format("event_log").load(str(tmp_path / "e"))
    assert log.schema == spark.createDataFrame([], EVENTS).schema
    assert sorted((r["id"], r["ts"], r["amount"], r["phase"]) for r in log.collect()) == [(f"e{i}", float(i), i, None) for i in range(5)]
    assert spark.read.format("captions").load(str(tmp_path / "e")).count() == 0


def test_a_stream_of_files_takes_each_once(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.vtt").write_text(VTT)
    spark.dataSource.register(Captions)
    stream = lambda: spark.readStream.format("captions").load(str(tmp_path / "v"))
    assert sorted(r["text"] for _, r in told(stream(), tmp_path, "s")) == ["Hello there", "late"]
    (tmp_path / "v/b.vtt").write_text("WEBVTT\n\n00:05.000 --> 00:06.000\nb\n")
    assert [r["text"] for _, r in told(stream(), tmp_path, "s")] == ["b"]
    assert told(stream(), tmp_path, "s") == []

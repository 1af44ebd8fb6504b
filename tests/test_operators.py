"""Operators on small literal tables, against brute force where SQL has no word for them."""

import itertools

from datetime import datetime, timedelta
import pytest
from pyspark.sql import functions as F

from lorespark.functions.similarity import dice
from lorespark.operators import etl, joins, match, transcript
from lorespark.sources import captions, catalog, pages
from lorespark.streaming import events


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_similarity_join_equals_all_pairs(spark):
    names = ["Kabalite Warriors", "Wyches", "Scourges", "Hellions", "Incubi", "Archon", "a", "ab", "Warp Talons", "Space Marine", "Marine"]
    terms = ["Kabalite Warrior", "witches", "scourge", "hellion squad", "a", "marines", "warp talon", "", "ba"]
    t, n = spark.createDataFrame([(x,) for x in terms], "term string"), spark.createDataFrame([(x,) for x in names], "name string")
    want = t.crossJoin(n).withColumn("score", dice(F.col("term"), F.col("name"))).filter("score >= 0.5")
    assert rows(match.similarity_join(t, n, "term", "name", 0.5)) == rows(want)


def test_match_chain_order(spark):
    names = spark.createDataFrame([("Wyches",), ("Kabalite Warriors",), ("Necrons",)], "name string")
    aliases = spark.createDataFrame([("witches", "Wyches")], "alias string, canonical string")
    terms = spark.createDataFrame([("Witches",), ("WYCHES",), ("Kabalite Warrior",), ("zzz",)], "term string")
    got = {r["term"]: (r["name"], r["matcher"]) for r in match.match_chain(terms, names, aliases).collect()}
    assert got["Witches"] == ("Wyches", "alias")
    assert got["WYCHES"] == ("Wyches", "exact")
    assert got["Kabalite Warrior"][0] == "Kabalite Warriors"
    assert got["zzz"] == (None, None)


def test_mentions_do_not_overlap(spark):
    seg = spark.createDataFrame([(1, "the space marine captain and the space wolf")], "id int, text string")
    words = spark.createDataFrame([("space marine", "SM", "u"), ("marine captain", "MC", "u"), ("space", "S", "u")], "term string, canonical string, kind string")
    got = match.longest_first(match.detect_mentions(seg, words, ["id"]), ["id"])
    assert [(r["at"], r["canonical"]) for r in got.orderBy("at").collect()] == [(2, "SM"), (7, "S")]


@pytest.mark.parametrize(("texts", "n"), [(["Hello world", "Hello world", "Different text"], 2), (["Hello", "World", "Hello"], 3)])
def test_drop_repeats(spark, texts, n):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "id int, at int, text string")
    assert transcript.drop_repeats(df, ["id"], ["at"]).count() == n


def test_sections_open_close_and_reopen(spark):
    data = [(0.0, "hello"), (3.0, "my army list is"), (6.0, "units"), (9.0, "time to deploy"), (120.0, "later"), (123.0, "the army list again"), (300.0, "too late, still taken"), (301.0, "out")]
    df = spark.createDataFrame([(1, s, t) for s, t in data], "id int, start double, text string")
    got = transcript.sections(df, "id", "start", "text", ["army list"], ["deploy", "first turn"], 120)
    assert [r["start"] for r in got.orderBy("start").collect()] == [3.0, 6.0, 9.0, 123.0, 300.0]


def test_pack(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 5, 20, 1])], "id int, at int, len int")
    got = transcript.pack(df, "id", "at", "len", 10)
    assert [r["chunk"] for r in got.orderBy("at").collect()] == [0, 0, 1, 2, 3]


def test_as_of_and_band(spark):
    ts = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    left = spark.createDataFrame([(1, 1, ts(5)), (2, 1, ts(1)), (3, 2, ts(5))], "id int, k int, ts timestamp")
    right = spark.createDataFrame([(1, ts(2), "a"), (1, ts(5), "b"), (1, ts(9), "c")], "k int, ts timestamp, v string")
    got = {r["id"]: r["v"] for r in joins.as_of(left, right, "k", "ts", ["v"]).collect()}
    assert got == {1: "b", 2: None, 3: None}
    near = joins.band(left, right, "k", "ts", 3).select("id", "r_v")
    assert rows(near) == [(1, "a"), (1, "b"), (2, "a")]


def test_upsert_keeps_null_keys_apart(spark):
    old = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v int")
    new = spark.createDataFrame([("a", 10), (None, 20), ("c", 30)], "k string, v int")
    got = etl.upsert(old, new, ["k"], ["v"])
    assert sorted(got.collect(), key=str) == sorted([("a", 10), (None, 2), (None, 20), ("b", 3), ("c", 30)], key=str)


def test_captions(spark):
    vtt = "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000\n<c>Hello</c> &amp; you\n\n00:00:01.200 --> 00:00:02.500\nHello &amp; you\n\n00:00:02.100 --> 00:00:03.000\nHello &amp; you\n\n00:00:02.300 --> 00:00:03.500\nNext\n"
    got = captions.parse(spark.createDataFrame([(1, vtt)], "id int, vtt string"), "id", "vtt").orderBy("start").collect()
    assert [(r["start"], round(r["duration"], 3), r["text"]) for r in got] == [(1.0, 1.0, "Hello & you"), (2.1, 0.9, "Hello & you"), (2.3, 1.2, "Next")]


def test_questions_and_sections(spark):
    html = "<h2>One</h2><p>aa</p><h3>Two</h3>bb" + "".join(f"<div><strong>Q:</strong> <em>q{i}?</em> <strong>A:</strong> a{i}.</div>" for i in range(3))
    page = spark.createDataFrame([(1, "http://x.org/a", html)], "page_id int, url string, html string")
    assert [(r["question"], r["answer"]) for r in pages.questions(page).orderBy("at").collect()] == [(f"q{i}?", f"a{i}.") for i in range(3)]
    assert [(r["level"], r["title"]) for r in pages.headed_sections(page).orderBy("at").collect()] == [("2", "One"), ("3", "Two")]


def test_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("Updated 12 June 2025", "June 2025", "on 2025-06-12", "none")], "t string")
    got = [r[0] and r[0].strftime("%Y-%m-%d") for r in df.select(pages.effective_date(F.col("t"))).collect()]
    assert got == ["2025-06-12", "2025-06-01", "2025-06-12", None]


def test_catalogue_json(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"id":"orks","name":"Orks","units":[{"name":"Boyz","weapons":[{"name":"Choppa"},{"name":"choppa"},{"name":"Slugga"}]}]}')
    c = catalog.catalogues(spark, str(tmp_path))
    assert rows(catalog.weapons(c).select("name")) == [("Choppa",), ("Slugga",)]


def test_stream_equals_batch(spark, tmp_path):
    deltas = [(k, i, d) for i, (k, d) in enumerate(itertools.product([1, 2, 3], [5, 5, -20, 3, 9, 9]))]
    df = spark.createDataFrame(deltas, "k bigint, at int, d int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.clamped_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "at", "d", 6, 0, 12)
    q = stream.writeStream.format("memory").queryName("clamped").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert rows(spark.table("clamped")) == rows(events.clamped(df, "k", "at", "d", 6, 0, 12))

"""Report checks, name joins, catalogue files, game helpers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.operators import joins, match, reports, transcript
from lorespark.sources import catalog, datasheets, factions
from lorespark.streaming import game

NAMES = ["Lanceguard", "Kryptark", "Overlord", "Farwatcher", "Stone Riders", "Interceptors"]


def test_validated_names(spark):
    official = spark.createDataFrame([("a", n) for n in NAMES] + [("b", "Farsight")], "scope string, official string")
    names = spark.createDataFrame([("a", n) for n in ("Lanceguards", "Cryptark", "Farwacher", "zzz", "", None)] + [("b", "Farsite"), ("c", "Farwatcher")], "scope string, name string")
    got = {(r["scope"], r["name"]): r for r in reports.validate_names(names, official).collect()}
    assert got["a", "Lanceguards"]["matched"] == "Lanceguard" and got["a", "Lanceguards"]["confidence"] == pytest.approx(10 / 11)
    assert got["a", "Cryptark"]["is_validated"] and got["a", "Cryptark"]["matched"] == "Kryptark"
    assert got["b", "Farsite"]["matched"] == "Farsight"
    for key in (("a", "zzz"), ("a", ""), ("c", "Farwatcher")):
        assert got[key]["matched"] is None and not got[key]["is_validated"] and got[key]["confidence"] == 0.0


def test_processed_entities(spark):
    official = spark.createDataFrame([("a", n) for n in NAMES], "scope string, official string")
    units = spark.createDataFrame(
        [(1, "a", "Lanceguard (unit)", "low"), (2, "a", "the lance", "low"), (3, "a", "Warp thing", "high"), (4, "b", "Farwatcher", "medium"), (5, "a", "hold the line", "low"), (6, "a", "Interceptor", "high")],
        "id int, scope string, name string, level string",
    )
    maps = spark.createDataFrame([("The Lance", "unit", "a", "Lanceguard"), ("the lance", "unit", None, "Overlord"), ("farwatcher", "stratagem", None, "x")], "alias string, kind string, scope string, canonical string")
    drop = spark.createDataFrame([("Hold the Line",)], "name string")
    done = reports.process_entities(units, official, maps, "unit", drop=drop)
    got = {r["id"]: r for r in done.collect()}
    assert set(got) == {1, 2, 3, 4, 6}
    assert [(got[i]["name"], got[i]["level"], got[i]["is_validated"]) for i in (1, 2, 3, 4)] == [("Lanceguard", "high", True), ("Lanceguard", "high", True), ("Warp thing", "medium", False), ("Farwatcher", "low", False)]
    assert got[6]["name"] == "Interceptors" and got[6]["level"] == "high"
    asked = reports.feedback(done).collect()
    assert {r["token"] for r in asked} == {"warp thing", "farwatcher"}


def test_overrides_win(spark):
    over = spark.createDataFrame([("ack horns", "Acorns"), ("gone", "Nobody")], "variation string, canonical string")
    names = spark.createDataFrame([("Acorns",), ("Elders",)], "name string")
    terms = spark.createDataFrame([("Ack Horns",), ("gone",), ("Akorns",)], "term string")
    got = {r["term"]: (r["name"], r["score"]) for r in match.phonetic_pairs(terms, names, "term", "name", 0.4, over).collect()}
    assert got["Ack Horns"] == ("Acorns", 0.95) and "gone" not in got and got["Akorns"][0] == "Acorns"


def test_first_containing_candidate_wins(spark):
    """In order of place the first name that holds the term counts, though a later one is more alike."""
    names = spark.createDataFrame([("Wallguards", 1), ("Wallguard", 2)], "name string, place int")
    terms = spark.createDataFrame([("wallguar",)], "term string")
    none = spark.createDataFrame([], "alias string, canonical string")
    got = match.match_chain(terms, names, none, least=0.7).first()
    assert match.first_containing(terms, names, "term", "name", "place").first()["name"] == "Wallguards"
    assert got["matcher"] in ("phonetic", "fuzzy")


def test_starting_with(spark):
    names = spark.createDataFrame([("a b",), ("apple b",), ("ab c",), ("",)], "name string")
    pairs = joins.starting_with(names, "name", F.split_part("name", F.lit(" "), F.lit(1)), names.withColumnRenamed("name", "longer"), "longer")
    got = {tuple(r) for r in pairs.filter("name <> longer").collect()}
    assert got == {("a b", "apple b"), ("a b", "ab c"), ("", "a b"), ("", "apple b"), ("", "ab c")}


def test_similarity_join_equals_all_pairs(spark):
    from twins import dice

    words = ["aaaa", "aaaab", "a", "b", "ab", "banana", "bananas", "ananas", "Ba-Na-Na", "", "x", "night", "nacht", "knight watch", "watch", "aaaaaaaaaa"]
    t, c = spark.createDataFrame([(w,) for w in words], "term string"), spark.createDataFrame([(w,) for w in words], "name string")
    for least in (0.2, 0.5, 0.7, 1.0):
        got = {(r["term"], r["name"]) for r in match.similarity_join(t, c, "term", "name", least).collect()}
        assert got == {(a, b) for a in words for b in words if dice(a, b) >= least}


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "f", "name": "F", "units": [{"name": "U", "weapons": [{"name": "Gun", "type": "ranged"}, {"name": "gun", "type": "melee"}], "keywords": ["K"], "pointsCost": 90}]}')
    (tmp_path / "b.json").write_text("{broken")
    c = catalog.catalogues(spark, str(tmp_path / "*.json"))
    assert [tuple(r) for r in catalog.units(c).select("faction_id", "name", "pointsCost").collect()] == [("f", "U", 90)]
    assert [(r["name"], r["type"]) for r in catalog.weapons(c).collect()] == [("Gun", "ranged")]
    (tmp_path / "al").mkdir()
    (tmp_path / "al" / "x.json").write_text('{"factionId": "f", "aliases": {"Unit One": [" U1 ", "one"]}}')
    assert {(r["alias"], r["canonical"]) for r in catalog.aliases(spark, str(tmp_path / "al")).collect()} == {("u1", "Unit One"), ("one", "Unit One")}
    (tmp_path / "c.cat").write_text('<catalogue><selectionEntries><selectionEntry name="U" type="unit"><costs><cost name="pts" value="80"/></costs></selectionEntry><selectionEntry name="V" type="upgrade"/></selectionEntries></catalogue>')
    xml = catalog.xml_entries(spark, str(tmp_path / "c.cat"), "`@_name` string, `@_type` string, costs struct<cost:array<struct<`@_name`:string,`@_value`:double>>>")
    assert {(r["@_name"], r["@_type"], r["costs"]["cost"][0]["@_value"] if r["costs"] else None) for r in xml.collect()} == {("U", "unit", 80.0), ("V", "upgrade", None)}


def test_weapon_names(spark):
    one = lambda n: tuple(spark.range(1).select(datasheets.weapon_name(F.lit(n), ["ignores cover", "torrent", "blast", "pistol"], ["autopistol"]).alias("w")).first()["w"])
    assert one("Bellow ignorescovertorrent") == ("Bellow ignorescovertorrent", []) or one("Bellowignorescovertorrent")[0] == "Bellow"
    assert one("Bellowignorescovertorrent") == ("Bellow", ["[IGNORES COVER]", "[TORRENT]"])
    assert one("Autopistol") == ("Autopistol", []) and one("Autopistolpistol") == ("Auto", ["[PISTOL]"])
    assert one("Gun [BLAST],") == ("Gun", ["[BLAST]"]) and one("Bolt pistol") == ("Bolt pistol", [])


def test_pages_without_anything(spark):
    pages = spark.createDataFrame([(1, "u", ""), (2, "u", None), (3, "u", "<table></table><a name=''></a><b>:</b>")], "page_id bigint, url string, html string")
    for f in (datasheets.stats, datasheets.points, datasheets.weapons, datasheets.abilities, factions.detachments, factions.stratagems, factions.enhancements, factions.section_html):
        assert f(pages).count() == 0
    assert datasheets.units(pages).count() == factions.faction(pages).count() == 3


def test_phonetic_scan_leaves_taken_spans(spark):
    segs = spark.createDataFrame([(1, "the acorns and akorns march")], "k int, text string")
    names = spark.createDataFrame([("Acorns",)], "name string")
    common = spark.createDataFrame([("march",)], "word string")
    taken = spark.createDataFrame([(1, 4, 10)], "k int, start int, end int")
    got = transcript.phonetic_scan(segs, names, ["k"], "text", "name", common, taken=taken).collect()
    assert [(r["start"], r["end"], r["matched"]) for r in got if r["phrase"] == "akorns"] == [(15, 21, "Acorns")]
    assert all(r["end"] <= 4 or r["start"] >= 10 for r in got)


def test_fan_out_goes_on_after_a_failure(spark):
    def work(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["id"] == 3).any():
            raise ValueError("worker")
        return batch

    rows = game.fan_out(spark.range(40), work, "id bigint", 8).collect()
    got = {r["id"] for r in rows if r["error"] is None}
    assert 3 not in got and len(got) > 10
    assert [(r["id"], r["error"]) for r in rows if r["error"]] == [(None, "ValueError: worker")]


def test_live_mentions(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "the farwatcher acts"), (1, 2, "nothing")], "video_id bigint, seq int, text string").write.json(str(src))
    words = spark.createDataFrame([("farwatcher", "Farwatcher", "unit")], "term string, canonical string, kind string")
    stream = spark.readStream.schema("video_id bigint, seq int, text string").json(str(src))
    q = game.live_mentions(stream, words).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["seq"], r["canonical"]) for r in spark.table("live").collect()] == [(1, "Farwatcher")]


def test_stages_and_their_artifacts(spark, tmp_path):
    from lorespark.operators.stages import run_stages

    good = [("double", lambda df: df.select((F.col("id") * 2).alias("id"))), ("some", lambda df: df.filter("id > 4"))]
    out, facts = run_stages(spark, spark.range(5), good, str(tmp_path / "a"))
    assert sorted(r["id"] for r in out.collect()) == [6, 8]
    assert [(r["name"], r["status"], r["rows"]) for r in facts.orderBy("stage").collect()] == [("double", "done", 5), ("some", "done", 2)]
    out, facts = run_stages(spark, spark.range(5), [good[0], ("bad", lambda df: df.select("missing")), good[1]], str(tmp_path / "b"))
    assert out is None and [r["status"] for r in facts.orderBy("stage").collect()] == ["done", "failed", "skipped"]

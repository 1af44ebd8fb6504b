"""Catalogue tools and game folds on small literal tables."""

import pytest

from lorespark.operators import transcript
from lorespark.operators.catalog_api import Catalog
from lorespark.schemas import EVENTS, TABLES
from lorespark.streaming import events as ev

ROWS = {
    "core_rules": [(1, "move", "Move", "movement_phase", "units move", 2), (2, "shoot", "Shoot", "combat", "hit rolls", 1)],
    "factions": [(1, "t-au-empire", "T'au Empire", None, False, "", ""), (2, "drukhari", "Drukhari", None, False, "", ""), (3, "dark-angels", "Dark Angels", None, True, "", "")],
    "detachments": [(1, "kauyon", "Kauyon", 1, "r", "t"), (2, "realspace", "Realspace Raiders", 2, "r", "t")],
    "units": [(1, "wyches", "Wyches", 2, '8"', 3, "6+", 1, "6+", 2, 90), (2, "archon", "Archon", 2, '8"', 3, "2+", 5, "6+", 1, 85), (3, "fire-warriors", "Fire Warriors", 1, '6"', 3, "4+", 1, "7+", 2, 80)],
    "weapons": [(1, "Hekatarii blade", "melee", "Melee", "4", "3+", "3", "-1", "1", ""), (2, "Pulse rifle", "ranged", '30"', "1", "4+", "5", "0", "1", "")],
    "unit_weapons": [(1, 1, True), (1, 1, True), (3, 2, True)],
    "abilities": [(1, "no-escape", "No Escape", "unit", "foes cannot fall back", 2)],
    "unit_abilities": [(1, 1)],
    "keywords": [(1, "DRUKHARI", "faction", "f"), (2, "INFANTRY", "unit_type", "i")],
    "unit_keywords": [(1, 1), (2, 1), (1, 2)],
    "stratagems": [(1, "s1", "Lightning Reflexes", 2, 2, "1", "any", "e"), (2, "s2", "Grenade", None, None, "1", "shooting", "e")],
    "enhancements": [(1, "e1", "Crucible", 2, 20, "d", None)],
    "faqs": [(1, "q1", "Can wyches fly?", "No", "units", 2)],
    "missions": [(1, "m1", "Take", "primary", "p")],
    "secondary_objectives": [(1, "o1", "Hold", "fixed", "d")],
}


@pytest.fixture(scope="module")
def cat(spark):
    return Catalog(spark, **{n: spark.createDataFrame(ROWS[n], s) for n, s in TABLES.items()})


def names(df, c="name"):
    return [r[c] for r in df.collect()]


def test_lookups(cat):
    assert names(cat.get_core_rules(), "title") == ["Shoot", "Move"]
    assert names(cat.get_core_rules("combat", "hit"), "title") == ["Shoot"]
    assert names(cat.list_factions()) == ["Dark Angels", "Drukhari", "T'au Empire"]
    assert cat.get_faction("T'au Empire").first()["n_units"] == 1
    assert names(cat.get_faction("drukh")) == ["Drukhari"]
    assert names(cat.get_detachments("drukhari")) == ["Realspace Raiders"]
    d = cat.get_detachment_details("drukhari", "real").first()
    assert [s["name"] for s in d["stratagems"]] == ["Lightning Reflexes"] and [e["name"] for e in d["enhancements"]] == ["Crucible"]
    assert cat.list_chapters().first()["samples"] == ["Archon", "Wyches"]


def test_units(cat):
    assert names(cat.search_units("W")) == ["Fire Warriors", "Wyches"]
    assert names(cat.search_units("w", "drukhari")) == ["Wyches"]
    assert names(cat.search_units("", keyword="infantry")) == ["Wyches"]
    assert names(cat.search_units("%")) == []
    u = cat.get_unit("wyches").first()
    assert (u["faction"], u["stats"]["toughness"], len(u["weapons"]), u["abilities"][0]["name"], len(u["keywords"])) == ("Drukhari", 3, 1, "No Escape", 2)
    assert cat.get_unit("nobody").count() == 0


def test_other_tools(cat):
    assert names(cat.get_stratagems()) == ["Grenade", "Lightning Reflexes"]
    assert names(cat.get_stratagems("drukhari", phase="fight")) == ["Lightning Reflexes"]
    assert names(cat.get_enhancements("drukhari")) == ["Crucible"]
    assert names(cat.search_weapons("pulse", "ranged")) == ["Pulse rifle"]
    assert names(cat.search_abilities("FALL BACK")) == ["No Escape"]
    assert names(cat.get_keyword_info("infantry")) == ["INFANTRY"]
    assert names(cat.get_missions("primary")) == ["Take"]
    assert names(cat.search_faqs("fly", "drukhari"), "slug") == ["q1"]


def test_names(spark, cat):
    assert names(cat.list_valid_names("units", "drukhari")) == ["Archon", "Wyches"]
    terms = spark.createDataFrame([("wyche",), ("zzzz",)], "term string")
    got = {r["term"]: (r["name"], r["category"], r["confidence"]) for r in cat.validate_terms(terms, ["units", "factions"]).collect()}
    assert got == {"wyche": ("Wyches", "units", 0.83), "zzzz": (None, None, None)}
    assert names(cat.fuzzy_search("archons", ["units"])) == ["Archon"]
    best = cat.resolve_ambiguous_term("wyche", ["drukhari"], "a drukhari list").first()
    assert (best["name"], best["relevance"], best["ambiguous"]) == ("Wyches", 1.0, False)


def test_normalize_and_tag(spark):
    seg = spark.createDataFrame([(1, "The witches attacked"), (1, "Witches and the dark eldar"), (2, "The witches")], "v int, text string")
    rep = spark.createDataFrame([(1, "witches", "Wyches", "unit"), (1, "dark eldar", "Drukhari", "faction"), (1, "dark", "Dark Angels", "faction")], "v int, original string, official string, type string")
    got = sorted(r["normalized"] for r in transcript.normalize_text(seg, rep, "v").collect())
    assert got == ["The witches", "The wyches attacked", "Wyches and the drukhari"]
    tagged = spark.createDataFrame([(1, "The Wyches attacked")], "v int, text string")
    assert transcript.tag_text(tagged, rep, "v").first()["tagged"] == "The [UNIT:Wyches] attacked"


def test_alias_variants(spark):
    got = {r["alias"]: r["canonical"] for r in transcript.alias_variants(spark.createDataFrame([("Wyches",), ("Kabalite Warriors",), ("Death Squad",)], "name string"), "name").collect()}
    assert got["kabalite warrior"] == "Kabalite Warriors" and got["death squads"] == "Death Squad" and "wyche" not in got


def test_game_folds(spark):
    rows = [
        ("a", 1, 1.0, 1, "movement", 0, "unit_moved", "u", None, "advance", None), ("b", 1, 2.0, 1, "charge", 0, "unit_charged", "u", False, None, None),
        ("c", 1, 3.0, 1, "fight", 0, "battleshock_test", "u", False, None, None), ("d", 1, 4.0, 2, "movement", 0, "unit_moved", "u", None, "normal", None),
        ("e", 1, 5.0, 2, "fight", 0, "unit_destroyed", "u", None, None, None), ("f", 1, 6.0, 1, "x", 0, "objective_taken", None, None, "A", None), ("g", 1, 7.0, 1, "x", 1, "objective_taken", None, None, "A", None),
    ]
    rows += [(f"p{i}", 2, float(i), 1, None, None, "next_phase", None, None, None, None) for i in range(13)]
    df = spark.createDataFrame(rows, EVENTS)
    u = ev.unit_status(df).first()
    assert (u["advanced"], u["has_charged"], u["battle_shocked"], u["destroyed"], u["destroyed_at"], u["destroyed_round"]) == (False, False, True, True, 5.0, 2)
    assert [(r["objective"], r["player"], r["since"]) for r in ev.owners(df).collect()] == [("A", 1, 7.0)]
    t = [(r["phase"], r["player"], r["round"]) for r in ev.turns(df).orderBy("ts").collect()]
    assert t[0] == ("movement", 0, 1) and t[5] == ("command", 1, 1) and t[11] == ("command", 0, 2)


def test_names_longer_than_a_thousand_characters_are_used_whole(spark):
    from types import SimpleNamespace

    from lorespark.plans import text as plans

    long = "ab" * 800
    seg = spark.createDataFrame([("v", f"x {long}c y"), ("v", f"x {long} y")], "v string, text string")
    rep = spark.createDataFrame([("v", long + "c", "Q" + long, "unit")], "v string, original string, official string, type string")
    got = sorted(r["normalized"] for r in transcript.normalize_text(seg, rep, "v").collect())
    assert got == sorted([f"x {('Q' + long).lower()} y", f"x {long} y"])
    part = spark.createDataFrame([("n" + long,)], "p_name string")
    assert [len(r["term"]) for r in plans.similarity_join(SimpleNamespace(part=part, spark=spark)).collect()] == [1601]

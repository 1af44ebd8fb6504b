"""Nested catalogue files (JSON and XML) and alias files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.functions.rules import is_legends
from lorespark.functions.text import decode_entities
from lorespark.operators.closure import reachable
from lorespark.sources import elements as el

WEAPON = "struct<name:string,type:string,range:string,attacks:string,skill:string,strength:string,ap:string,damage:string,keywords:array<string>>"
UNIT = f"struct<name:string,canonicalName:string,stats:struct<movement:string,toughness:int,save:string,wounds:int,leadership:string,objectiveControl:int>,weapons:array<{WEAPON}>,abilities:array<string>,keywords:array<string>,pointsCost:int>"
CATALOGUE = f"id string, name string, units array<{UNIT}>"
ALIASES = "factionId string, factionName string, generatedAt string, aliases map<string,array<string>>"


def catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue documents; files that do not parse are left out."""
    return spark.read.schema(CATALOGUE).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def units(catalogue: DataFrame) -> DataFrame:
    return catalogue.select(F.col("id").alias("faction_id"), F.posexplode("units").alias("at", "u")).select("faction_id", "at", "u.*")


def weapons(catalogue: DataFrame) -> DataFrame:
    """One row per weapon of a unit; equal names (but for case) once, the first."""
    each = units(catalogue).select("faction_id", F.col("name").alias("unit"), F.posexplode("weapons").alias("at", "w")).select("faction_id", "unit", "at", "w.*")
    low = each.withColumn("_low", F.lower("name"))
    first = low.groupBy("faction_id", "unit", "_low").agg(F.min("at").alias("at"))
    return low.join(first, ["faction_id", "unit", "_low", "at"]).drop("_low")


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(faction_id, alias, canonical): canonical -> [alias] turned round."""
    files = spark.read.schema(ALIASES).option("multiLine", True).json(path)
    pairs = files.select(F.col("factionId").alias("faction_id"), F.explode("aliases").alias("canonical", "names"))
    return pairs.select("faction_id", "canonical", F.explode("names").alias("alias")).select("faction_id", F.lower(F.trim("alias")).alias("alias"), "canonical")


def dictionary(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """Union of alias tables (alias, canonical); where several know an alias the highest precedence wins."""
    from lorespark.operators.etl import latest

    out = None
    for rank, t in sources:
        one = t.select(F.lower(F.trim("alias")).alias("alias"), "canonical", F.lit(rank).alias("rank"))
        out = one if out is None else out.unionByName(one)
    return latest(out, ["alias"], [F.col("rank").desc(), "canonical"]).drop("rank")


def xml_entries(spark: SparkSession, path: str, schema: str, row_tag: str = "selectionEntry") -> DataFrame:
    """Entries of XML catalogues, attributes under @_ names."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@_").option("valueTag", "#text").schema(schema).load(path)


def visible_links(links: DataFrame, not_units: list[str]) -> DataFrame:
    """Entry links (catalogue, name, type, hidden, conditions) of units: entries that are shown, whose names hold none of the words for other things and are no legends."""
    other = F.exists(F.array(*[F.lit(w) for w in not_units]), lambda w: F.contains("name", w)) if not_units else F.lit(False)
    return links.filter((F.col("type") == "selectionEntry") & ~F.coalesce(F.col("hidden"), F.lit(False)) & ~other & ~is_legends(F.col("name")))


def ally_conditions(links: DataFrame, flags: DataFrame, gate_id: str | None = None) -> DataFrame:
    """(catalogue, name, ally_group): units by what shows them; a null group is the core.

    links: catalogue, name, conditions (array of structs type, value, child_id;
    null: always shown). flags: child_id, type, value, ally_group. A unit with
    a condition that is a flag's belongs to its group, one without conditions,
    or with an "atLeast" condition on the gate, to the core; others are left out.
    """
    each = links.select("catalogue", "name", F.explode_outer("conditions").alias("c")).select("catalogue", "name", "c.*")
    marked = each.join(flags.withColumnRenamed("type", "t").withColumnRenamed("value", "v").withColumnRenamed("child_id", "i"), (F.col("child_id") == F.col("i")) & (F.col("type") == F.col("t")) & (F.col("value") == F.col("v")), "left")
    gate = F.coalesce((F.col("type") == "atLeast") & (F.col("child_id") == F.lit(gate_id)), F.lit(False))
    per = marked.groupBy("catalogue", "name").agg(F.collect_set("ally_group").alias("groups"), F.max(F.col("child_id").isNull() | gate).alias("core"))
    kept = per.filter((F.size("groups") > 0) | F.col("core"))
    return kept.select("catalogue", "name", F.explode_outer("groups").alias("ally_group"))


def detachment_units(allies: DataFrame, detachments: DataFrame) -> DataFrame:
    """(catalogue, detachment, units): the core units and those of the ally groups that a detachment (catalogue, detachment, ally_groups) allows, sorted."""
    met = detachments.join(allies, "catalogue").filter(F.col("ally_group").isNull() | F.array_contains("ally_groups", F.col("ally_group")))
    return met.groupBy("catalogue", "detachment").agg(F.array_sort(F.collect_set("name")).alias("units"))


def faction_aliases(factions: DataFrame, known: DataFrame) -> DataFrame:
    """(id, alias) of factions (id, name): the name in lower case, its known aliases (name, alias), and its id in words."""
    own = factions.select("id", F.explode(F.array_distinct(F.array(F.lower("name"), F.replace("id", F.lit("-"), F.lit(" "))))).alias("alias"))
    return own.union(factions.join(known, "name").select("id", F.lower("alias"))).distinct()


def clean_aliases(generated: DataFrame, existing: DataFrame, official: DataFrame) -> DataFrame:
    """(name, aliases) of official unit names: generated and existing aliases (unit, alias), met without case and without
    "[Legends]"; aliases in lower case, each once, none that is the name itself; units that are not official are left out."""
    low = F.lower("name")
    names = official.select("name", F.explode(F.array_distinct(F.array(low, F.regexp_replace(low, r"\s*\[legends\]$", "")))).alias("k")).groupBy("k").agg(F.min("name").alias("name"))
    given = generated.select("unit", "alias").union(existing.select("unit", "alias")).select(F.lower("unit").alias("k"), F.lower(F.trim("alias")).alias("alias"))
    met = given.join(names, "k").filter((F.col("alias") != "") & (F.col("alias") != F.lower("name")))
    return met.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def batch_results(results: DataFrame) -> DataFrame:
    """(group, results): lines of a batch (custom_id "group:part", aliases map) put together by group; of equal keys the last part's holds."""
    each = results.select(F.split_part("custom_id", F.lit(":"), F.lit(1)).alias("group"), F.split_part("custom_id", F.lit(":"), F.lit(2)).alias("part"), F.explode("aliases").alias("unit", "names"))
    last = each.groupBy("group", "unit").agg(F.max_by("names", F.struct(F.length("part"), "part")).alias("names"))
    return last.groupBy("group").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit", "names")))).alias("results"))


def nested_entries(files: DataFrame, text: str = "xml", key: str = "catalogue") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Selection entries of XML catalogues at any depth: (entries, links, profiles).

    files: a unique key and the text of a catalogue. entries: key, entry_id,
    name, type, hidden. links: a, b, entry ids: of an entry and one nested in
    it, also through groups, or named by an entry link. profiles: key,
    entry_id, name, type_name, values (name -> text). An entry without an id
    gets one of its place.
    """
    told = el.inner_of(el.inner_of(el.tokens(files, text, key), "selectionentry", "entry_at", key), "profile", "profile_at", key)
    token = F.col("token")
    at = lambda name: el.attribute(token, name)
    opened = told.filter("tag in ('selectionentry', 'entrylink') and (step = 1 or tag = 'entrylink' and step = 0)").join(el.outer_of(told, "selectionentry", key), [key, "at"], "left")
    opened = opened.withColumn("around", F.when(F.col("tag") == "selectionentry", F.col("outer")).otherwise(F.col("entry_at")))
    place = lambda c: F.concat(F.col(key).cast("string"), F.lit("#"), F.col(c).cast("string"))
    is_entry = F.col("tag") == "selectionentry"
    rows = opened.select(key, "at", "around", is_entry.alias("is_entry"), at("id").alias("id"), at("name").alias("name"), at("type").alias("type"), F.coalesce(at("hidden") == "true", F.lit(False)).alias("hidden"), at("targetId").alias("target"))
    entries = rows.filter("is_entry").withColumn("entry_id", F.coalesce("id", place("at")))
    ids = entries.select(key, F.col("at").alias("entry_at"), "entry_id")
    around = rows.join(ids.select(key, F.col("entry_at").alias("around"), F.col("entry_id").alias("a")), [key, "around"])
    nested = around.select("a", F.when(F.col("is_entry"), F.coalesce("id", place("at"))).otherwise(F.col("target")).alias("b"))
    inside = told.filter("profile_at is not null and profile_at > entry_at")
    named = inside.filter("tag in ('profile', 'characteristic') and step = 1 or tag is null").withColumn("label", F.last(F.when(F.col("tag") == "characteristic", at("name")), ignorenulls=True).over(Window.partitionBy(key, "profile_at").orderBy("at")))
    head = named.filter("tag = 'profile'").select(key, "profile_at", "entry_at", at("name").alias("name"), at("typeName").alias("type_name"))
    worth = named.filter("tag is null and label is not null").select(key, "profile_at", "at", "label", F.trim(decode_entities(token)).alias("value")).filter("value <> ''")
    first = worth.groupBy(key, "profile_at", "label").agg(F.min_by("value", "at").alias("value"))
    values = first.groupBy(key, "profile_at").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "value")))).alias("values"))
    profiles = head.join(values, [key, "profile_at"], "left").join(ids, [key, "entry_at"]).select(key, "entry_id", "name", "type_name", "values")
    return entries.select(key, "entry_id", "name", "type", "hidden"), nested.filter("b is not null"), profiles


def entry_profiles(files: DataFrame, type_names: list[str], text: str = "xml", key: str = "catalogue") -> DataFrame:
    """(key, unit, name, type_name, values): profiles of some types that a shown entry of type unit holds at any depth, over nested entries, groups and entry links; of equal names the nearest."""
    entries, links, profiles = nested_entries(files, text, key)
    shown = entries.filter("type = 'unit' and not hidden")
    reach = reachable(shown.select(F.col("entry_id").alias("start")), links)
    held = reach.join(profiles.drop(key).filter(F.col("type_name").isin(type_names)), reach["node"] == profiles["entry_id"])
    once = held.groupBy("start", "name").agg(F.min_by(F.struct("type_name", "values"), F.struct("steps", "node", "type_name")).alias("p"))
    return shown.select(key, F.col("entry_id").alias("start"), F.col("name").alias("unit")).join(once, "start").select(key, "unit", "name", "p.type_name", "p.values")

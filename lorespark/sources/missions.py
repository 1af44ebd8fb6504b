"""Mission pack pages as rows of four kinds: missions, secondaries, gambits and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import rules
from lorespark.functions.text import slugify, title_case
from lorespark.sources import html as h

# The class of a card by its kind, and the anchors of rules with their titles and categories.
CARDS = {"mission": "mission", "secondary": "secondary", "gambit": "challenger|gambit"}
RULES = [
    ("Chapter-Approved-Battles", "Chapter Approved Battles", "battle_sequence"),
    ("Set-Mission-Parameters", "Set Mission Parameters", "mission_parameters"),
    ("Muster-Armies", "Muster Armies", "army_construction"),
    ("Determine-Mission", "Determine Mission", "determine_mission"),
    ("Place-Objective", "Place Objective Markers", "objectives"),
    ("Create-The-Battlefield", "Create The Battlefield", "terrain"),
    ("Select-Secondary", "Select Secondary Missions", "secondary_selection"),
    ("Deploy-Armies", "Deploy Armies", "deployment"),
    ("Challenger-Cards", "Challenger Cards", "challengers"),
    ("Determine-Victor", "Determine Victor", "victory_conditions"),
    ("Terrain-Layout", "Terrain Layouts", "terrain_layouts"),
]


def cards(pages: DataFrame) -> DataFrame:
    """(page_id, kind, slug, name, category, max_points, has_action, timing, effect, content) of cards of 20 characters or more.

    A card's name is its heading, or else its first line; those of missions and
    secondaries are in capitals. Names equal but for case count once a kind. A
    secondary is tactical, fixed or both; max_points is the largest number
    before VP.
    """
    out = None
    for kind, classes in CARDS.items():
        b = h.blocks(pages, rf'<div\b[^>]*class="[^"]*(?:{classes})[^"]*"[^>]*>')
        body = h.text_of(F.regexp_replace("block", r"(?is)</(?:div|p|h\d|li|b)>|<br\s*/?>", "\n"))
        heading = h.text_of(F.regexp_extract("block", r"(?is)<(h3|h4|b)\b[^>]*>(.*?)</\1>", 2))
        first = F.trim(F.element_at(F.split(body, "\n"), 1))
        fit = F.length(heading) >= 3 if kind == "gambit" else rules.mission_name(heading)
        name = F.when(fit, heading) if kind == "gambit" else F.when(fit, heading).otherwise(F.when(rules.mission_name(first), first))
        one = b.withColumns({"body": body, "card": name}).filter((F.length("body") >= 20) & F.col("card").isNotNull())
        one = one.withColumns({"kind": F.lit(kind), "content": F.regexp_replace(F.replace("body", F.col("card"), F.lit("")), r"^\s+|\s+$", "")})
        out = one if out is None else out.unionByName(one)
    once = Window.partitionBy("page_id", "kind", F.lower("card")).orderBy("at")
    kept = out.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    category = F.when(F.col("content").contains("FIXED") & F.col("content").contains("TACTICAL"), "both").when(F.col("content").contains("Fixed Mission"), "fixed").otherwise("tactical")
    points = F.array_max(F.transform(F.regexp_extract_all("content", F.lit(r"(\d+)VP"), 1), lambda x: x.cast("int")))
    part = lambda label: F.nullif(F.trim(F.regexp_extract("content", rf"(?s){label}:\s*(.*?)(?=\n|$)", 1)), F.lit(""))
    return kept.select(
        "page_id", "kind", slugify(F.col("card")).alias("slug"), title_case(F.col("card")).alias("name"), F.when(F.col("kind") == "secondary", category).alias("category"),
        F.when(F.col("kind") == "secondary", points).alias("max_points"), (F.col("content").contains("(ACTION)") | F.col("content").contains("Action:")).alias("has_action"), part("WHEN").alias("timing"), part("EFFECT").alias("effect"), "content",
    )


def matched_play_rules(pages: DataFrame) -> DataFrame:
    """(page_id, slug, title, category, content) of the rule sections that a page has, of 50 characters or more."""
    a = h.anchors(pages)
    kind = F.lit(None).cast("struct<title:string,category:string>")
    for part, title, category in reversed(RULES):
        kind = F.when(F.col("anchor").contains(part), F.struct(F.lit(title).alias("title"), F.lit(category).alias("category"))).otherwise(kind)
    told = a.withColumns({"k": kind, "content": h.text_of(F.regexp_replace("section", r"(?is)</(?:div|p|h\d|li)>|<br\s*/?>", "\n"))}).filter("k is not null")
    long = told.filter(F.length("content") >= 50)
    return long.groupBy("page_id", "k").agg(F.min_by("content", "at").alias("content")).select("page_id", slugify(F.col("k.title")).alias("slug"), "k.title", "k.category", "content")

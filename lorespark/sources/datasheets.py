"""Datasheet pages as rows: stats, points, weapons, abilities, keywords and the texts around them.

Pages go through the JVM only. Tables hold no tables, and blocks are found by
their tags and classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import rules
from lorespark.functions.text import parse_int, slugify
from lorespark.operators.integrity import any_of
from lorespark.sources import elements as el
from lorespark.sources import html as h

# Bold texts with a colon that are references to rules and not abilities of a unit.
NOT_ABILITIES = [
    "^(?:WHEN|TARGET|EFFECT|RESTRICTIONS|KEYWORDS):?$", "^hit roll", "^saving throw", "^wound roll", "^advance move", "^fall back move", "^normal move", "^desperate escape",
    "^engagement range", "^unmodified dice", "^feel no pain", "^benefit of cover", "^critical hit", "^critical wound", "^deadly demise", "^this model is equipped",
    "^every model is equipped", "^example", "^designer.?s note", "^stratagems?$", "^enhancements?$", "^detachment rule", "^army rule", "^invulnerable save$",
    "^unit composition$", "^wargear options?$", "^leader$", "^combat patrol$", "^incursion$", "^strike force$", "^onslaught$",
]
INLINE_STATS = r'M\s+(\d+"?)\s+T\s+(\d+)\s+Sv\s+(\d+\+?)\s+W\s+(\d+)\s+Ld\s+(\d+\+?)\s+OC\s+(\d+)'


def _told(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def stats(pages: DataFrame) -> DataFrame:
    """(page_id, movement, toughness, save, wounds, leadership, objective_control) of pages that tell them: the first
    table whose header names them, or else a line of letters and numbers."""
    is_stats = F.col("head").contains("M") & F.col("head").contains("T") & (F.col("head").contains("SV") | F.col("head").contains("SAVE")) & F.col("head").contains("W")
    first = h.tables(pages).filter(is_stats).groupBy("page_id").agg(F.min_by(F.col("rows")[0]["cells"], "table_no").alias("c"))
    cell = lambda i: F.when(F.size("c") >= 6, _told(F.get("c", F.lit(i))))
    body = h.text_of(F.col("html"))
    inline = lambda i: _told(F.regexp_extract(body, INLINE_STATS, i))
    fallback = parse_int(cell(1)).isNull() & (F.regexp_extract(body, INLINE_STATS, 0) != "")
    text = lambda i: F.when(fallback, inline(i + 1)).otherwise(cell(i))
    number = lambda i: parse_int(text(i))
    out = pages.select("page_id", "html").join(first, "page_id", "left")
    out = out.select("page_id", text(0).alias("movement"), number(1).alias("toughness"), text(2).alias("save"), number(3).alias("wounds"), number(4).alias("leadership"), number(5).alias("objective_control"))
    return out.filter("movement is not null or toughness is not null or save is not null")


def facts(pages: DataFrame) -> DataFrame:
    """(page_id, invulnerable_save, base_size, leader_of, composition): what the text of a page says of its unit."""
    body = h.text_of(F.col("html"))
    found = lambda pattern: _told(F.regexp_extract(body, pattern, 1))
    marked = _told(F.regexp_extract(F.regexp_extract("html", r'(?is)class="[^"]*invuln[^"]*"[^>]*>(.*?)</', 1), r"(\d+\+)", 1))
    save = F.coalesce(found(r"(?i)INVULNERABLE SAVE\s*(\d+\+)"), marked, found(r"(?i)has\s+a?\s*(\d+\+)\s*invulnerable save"))
    listed = F.split(F.regexp_extract(body, r"(?is)LEADER.*?(?:can be attached to the following unit|can attach to)s?:\s*(.*?)(?=KEYWORDS:|FACTION KEYWORDS:|STRATAGEMS|DETACHMENT|$)", 1), r"[-•\n]")
    units = F.slice(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: (F.length(x) > 2) & ~x.contains("KEYWORDS")), 1, 10)
    parts = rules.clean_composition(F.regexp_replace(F.regexp_extract(body, r"(?is)UNIT COMPOSITION\s*(.*?)(?=LEADER|KEYWORDS:|FACTION KEYWORDS:|STRATAGEMS|DETACHMENT|\d+CP|$)", 1), r"\d{3}\s+\d{3}", ""))
    return pages.select("page_id", save.alias("invulnerable_save"), found(r"\(⌀(\d+mm(?:\s+oval)?)\)").alias("base_size"), units.alias("leader_of"), _told(parts).alias("composition"))


def points(pages: DataFrame) -> DataFrame:
    """(page_id, points): the first number of a table of models that can be a unit's points."""
    priced = h.tables(pages).filter(F.lower("text").contains("model") & F.col("text").rlike(r"\d{2,}"))
    each = priced.select("page_id", "table_no", F.posexplode(F.flatten(F.transform("rows", lambda r: r["cells"]))).alias("at", "cell"))
    number = F.when(F.col("cell").rlike(r"^\d{2,3}$"), F.col("cell").cast("int"))
    return each.withColumn("points", number).filter(rules.valid_points(F.col("points"))).groupBy("page_id").agg(F.min_by("points", F.struct("table_no", "at")).alias("points"))


def _keyword_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda k: F.upper(F.regexp_replace(F.trim(k), r"\s+", " "))), lambda k: k != "")


def keywords(pages: DataFrame) -> DataFrame:
    """(page_id, keywords): unit keywords, then faction keywords, each once; from their columns, or else from lines of the text."""
    column = lambda name, label: F.regexp_extract(h.of_class(F.col("html"), name, "div"), rf"{label}:?\s*([\s\S]*)$", 1)
    listed = F.concat(_keyword_list(column("dsLeftCol", "KEYWORDS")), _keyword_list(column("dsRightColKW", "FACTION KEYWORDS")))
    has_columns = F.col("html").rlike(r'(?i)class="[^"]*\bdsRightColKW\b') & (F.size(listed) > 0)
    body = h.text_of(F.regexp_replace("html", r"(?i)</(?:div|p|td|tr|li|h\d)>|<br\s*/?>", "\n"))
    lines = F.concat(_keyword_list(F.regexp_extract(body, r"KEYWORDS:?\s*([^\n]+)", 1)), _keyword_list(F.regexp_extract(body, r"FACTION\s+KEYWORDS:?\s*([^\n]+)", 1)))
    return pages.select("page_id", F.array_distinct(F.when(has_columns, listed).otherwise(lines)).alias("keywords"))


def weapon_name(c: Column, abilities: list[str], whole: list[str] = ()) -> Column:
    """(name, abilities) of a weapon's name that abilities in brackets, or grown on to it without a space, follow.

    whole: lower-case names that end in an ability and stay as they are.
    """
    bracketed = F.regexp_extract_all(c, F.lit(r"\[[A-Z][A-Z\s-]+\]"), 0)
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[[A-Z][A-Z\s-]+\]", ""), r",\s*$", ""), r"\s+", " "))
    start = F.struct(name.alias("name"), bracketed.alias("found"), F.lit(False).alias("done"))
    if not abilities:
        return F.struct(start["name"].alias("name"), F.array_distinct(start["found"]).alias("abilities"))
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(a.replace(" ", "")).alias("joined")) for a in abilities])
    keep = F.array(*[F.lit(w) for w in whole]) if whole else F.array().cast("array<string>")

    def split_one(acc: Column, _: Column) -> Column:
        before = lambda k: F.call_function("regexp_extract", acc["name"], F.concat(F.lit("(?i)^(.*?[^ –-])"), k["joined"]), F.lit(1))
        hits = F.filter(F.transform(known, lambda k: F.struct(k["a"].alias("a"), k["joined"].alias("joined"), before(k).alias("before"))), lambda k: (k["before"] != "") & ~F.array_contains(keep, F.lower(F.trim(k["before"]))))
        hit = F.when(~F.array_contains(keep, F.lower(acc["name"])), F.get(hits, F.lit(0)))
        rest = F.regexp_replace(acc["name"], F.concat(F.lit("(?i)(?<=[^ –-])"), hit["joined"]), F.lit(""))
        found = F.when(hit.isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.concat(F.lit("["), F.upper(hit["a"]), F.lit("]")))))
        return F.when(acc["done"], acc).otherwise(F.struct(F.coalesce(F.trim(rest), acc["name"]).alias("name"), found.alias("found"), hit.isNull().alias("done")))

    # A name holds no more abilities than the shortest of them fits into it; once none is found the rest is passed over.
    most = F.floor(F.length(c) / min(len(a.replace(" ", "")) for a in abilities)).cast("int") + 1
    state = F.aggregate(F.sequence(F.lit(1), most), start, split_one)
    return F.struct(state["name"].alias("name"), F.array_distinct(state["found"]).alias("abilities"))


def weapons(pages: DataFrame, abilities: list[str] = (), whole: list[str] = ()) -> DataFrame:
    """Rows of a page's weapon tables: page_id, at, name, weapon_type, range, attacks, skill, strength, armor_penetration, damage, abilities.

    A table is of weapons if its header names a range or a skill; tables of
    deeds and of points are not, and rows that repeat a header neither. Names
    equal but for case count once, the first. A range of "Melee" makes a
    melee weapon.
    """
    head = F.concat_ws(" ", "head", "first")
    is_ranged = head.contains("RANGE") | head.contains("BS") | head.contains("RANGED WEAPON")
    is_melee = head.contains("WS") | head.contains("MELEE WEAPON")
    other = head.contains("DEED") | head.contains("D6") | head.contains("VOW") | (head.contains("MODELS") & head.contains("POINTS"))
    t = h.tables(pages).filter((is_ranged | is_melee) & ~other).withColumn("kind", F.when(is_ranged & ~is_melee, "ranged").otherwise("melee"))
    rows = t.select("page_id", "kind", "table_no", F.posexplode("rows").alias("row_no", "r")).filter(F.size("r.cells") >= 6)
    # The name is in the first cell with text; a marker of one or two characters may stand before it.
    spot = F.array_position(F.transform("r.cells", lambda x: x != ""), True).cast("int")
    at = F.when((F.length(F.element_at("r.cells", F.greatest(spot, F.lit(1)))) < 3) & (F.size("r.cells") > spot), spot + 1).otherwise(F.greatest(spot, F.lit(1)))
    tags = lambda c: F.regexp_replace(c, r'(?is)<span[^>]*class="[^"]*\bkwb2\b[^"]*"[^>]*>(?:<span[^>]*>)?[^<]*(?:</span>)?</span>', "")
    cell = F.element_at("r.html", F.col("at"))
    marked = F.transform(F.regexp_extract_all(cell, F.lit(r'(?is)<span[^>]*class="[^"]*\bkwb2\b[^"]*"[^>]*>(?:<span[^>]*>)?([^<]*)'), 1), lambda x: F.concat(F.lit("["), F.upper(F.trim(x)), F.lit("]")))
    bare = F.regexp_replace(F.regexp_replace(h.text_of(tags(cell)), r"\s+", " "), r"^\s*[-–]\s*", "")
    # A generator keeps the name's fold below the filters that use it, so that it is evaluated once.
    named = rows.withColumn("at", at).withColumns({"w": F.explode(F.array(weapon_name(bare, list(abilities), list(whole)))), "marked": F.filter(marked, lambda x: F.length(x) > 3)})
    value = lambda i: F.get("r.cells", F.col("at") + (i - 1))
    up, first = F.upper("w.name"), F.upper(F.col("r.cells")[0])
    header = first.isin("RANGED WEAPONS", "MELEE WEAPONS", "WEAPON", "WEAPONS") | first.contains("RANGE") | first.contains("---") | up.contains("RANGED WEAPON") | up.contains("MELEE WEAPON") | up.isin("RANGE", "WEAPON", "WEAPONS") | up.contains("DEED") | up.contains("VOW")
    header = header | (F.upper(F.coalesce(value(1), F.lit(""))) == "RANGE") | F.upper(F.coalesce(value(2), F.lit(""))).isin("A", "ATTACKS")
    good = named.filter(F.length("w.name").between(2, 100) & ~header)
    once = Window.partitionBy("page_id", F.lower("w.name")).orderBy("table_no", "row_no")
    kept = good.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    kind = F.when(F.lower(value(1)) == "melee", "melee").otherwise(F.col("kind"))
    stat = {n: _told(value(i)) for i, n in enumerate(("range", "attacks", "skill", "strength", "armor_penetration", "damage"), 1)}
    return kept.select("page_id", slugify(F.col("w.name")).alias("slug"), F.col("w.name").alias("name"), kind.alias("weapon_type"), *[v.alias(n) for n, v in stat.items()], F.array_distinct(F.concat("marked", "w.abilities")).alias("abilities"))


def abilities(pages: DataFrame, fixes: dict[str, str] | None = None) -> DataFrame:
    """(page_id, slug, name, ability_type, description) of a page's bold texts: lists after CORE: and FACTION:, and names with
    a colon before their description. References to rules, too short names and descriptions go; equal names (but for case) count once."""
    part = h.blocks(pages, r"<(?:b|strong)\b[^>]*>")
    told = part.select("page_id", "at", h.text_of(F.regexp_extract("block", r"(?is)^<(b|strong)\b[^>]*>(.*?)</\1>", 2)).alias("bold"), F.regexp_extract("block", r"(?is)^<(b|strong)\b[^>]*>.*?</\1>(.*?)(?=</(?:p|div|td|li)>|<h\d|$)", 2).alias("rest"))
    kind = F.when(F.upper("bold").startswith("CORE:"), "core").when(F.upper("bold").startswith("FACTION:"), "faction").when(F.col("bold").contains(":"), "unit")
    lists = F.transform(F.split(rules.normalize_text(F.regexp_replace("bold", r"(?i)^(?:CORE|FACTION):\s*", ""), fixes or {}), ","), lambda x: F.trim(x))
    names = F.when(F.col("kind") == "unit", F.array(F.trim(F.regexp_replace("bold", ":$", "")))).otherwise(lists)
    each = told.withColumn("kind", kind).filter("kind is not null").select("page_id", "at", "kind", "rest", F.posexplode(names).alias("i", "name"))
    about = F.trim(F.regexp_replace(F.regexp_replace(h.text_of(F.col("rest")), r"^\s*:\s*", ""), r"\s+", " "))
    text = F.when(F.col("kind") == "unit", rules.repeated_keywords(about)).otherwise(F.concat(F.upper("kind"), F.lit(" ability")))
    full = each.withColumn("description", text)
    unit_ok = F.length("name").between(3, 100) & ~any_of(F.col("name"), NOT_ABILITIES) & (F.length("description") >= 10) & ~F.col("description").rlike(r"^\|[\s|]*$")
    good = full.filter(F.when(F.col("kind") == "unit", unit_ok).otherwise(F.length("name") >= 3))
    order = F.array_position(F.array(F.lit("core"), F.lit("faction"), F.lit("unit")), F.col("kind"))
    once = Window.partitionBy("page_id", F.lower("name")).orderBy(order, "at", "i")
    return good.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("page_id", slugify(F.col("name")).alias("slug"), "name", F.col("kind").alias("ability_type"), "description")


def units(pages: DataFrame, hidden: list[str] = ()) -> DataFrame:
    """One row per page (page_id, url, html): name, slug, stats, points, facts, keywords and what follows from them; list columns as arrays.

    hidden: classes whose elements, whatever they hold, are taken out before a page is read.
    """
    pages = el.without(pages, list(hidden)) if hidden else pages
    title = h.text_of(F.regexp_extract("html", r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    head = h.text_of(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    name = F.trim(F.regexp_replace(F.coalesce(_told(title), _told(F.regexp_extract(head, r"[–-]\s*([^\[–-]+)", 1)), head), r"\s*[\[|].*$", ""))
    base = pages.select("page_id", "url", name.alias("name"), slugify(name).alias("slug"))
    for part in (stats(pages), points(pages), facts(pages), keywords(pages)):
        base = base.join(part, "page_id", "left")
    has = lambda k: F.coalesce(F.array_contains("keywords", F.lit(k)), F.lit(False))
    return base.withColumns({"is_epic_hero": has("EPIC HERO"), "is_battleline": has("BATTLELINE"), "is_dedicated_transport": has("DEDICATED TRANSPORT")})

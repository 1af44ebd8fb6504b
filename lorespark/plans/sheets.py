"""Queries over pages made of the star schema's rows: what a parser finds is what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.plans import Tables, query
from lorespark.sources import datasheets, factions, missions


def page(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("html")


def _sheet(t: Tables) -> DataFrame:
    """A datasheet per part: stats and points from its numbers, weapons and keywords from its name and type."""
    size, n = F.col("p_size"), F.col("p_name")
    # Parsing is all that costs here: rows of a table in one small file are dealt out to all tasks first.
    return t.part.repartition(t.spark.sparkContext.defaultParallelism).select(
        F.col("p_partkey").alias("page_id"),
        F.lit("http://x/datasheets").alias("url"),
        page(
            "<html><title>Sheet</title><h1>", n, " [Legends]</h1><div class='x'><table><tr><th>M</th><th>T</th><th>Sv</th><th>W</th><th>Ld</th><th>OC</th></tr><tr><td>", size % 13, '"</td><td>', size % 7, "</td><td>", size % 5 + 2, "+</td><td> ", size, " </td><td>6+</td><td>0</td></tr></table>",
            "<p>INVULNERABLE SAVE ", size % 3 + 4, "+</p><table><tr><th>Unit</th><th>Points</th></tr><tr><td>1 model</td><td>", size * 5, "</td></tr></table>",
            '<table><tr><th>RANGED WEAPONS</th><th>RANGE</th><th>A</th><th>BS</th><th>S</th><th>AP</th><th>D</th></tr><tr><td><span>', n, ' rifle <span class="kwb2">blast</span></span></td><td>24"</td><td>', size % 4, '</td><td>3+</td><td>5</td><td>-1</td><td>2</td></tr>',
            '<tr><td>', F.upper(n), ' RIFLE</td><td>12"</td><td>1</td><td>3+</td><td>5</td><td>-1</td><td>2</td></tr><tr><td>-</td><td>', n, ' bladeheavy</td><td>Melee</td><td>2</td><td>3+</td><td>5</td><td>0</td><td>1</td></tr></table>',
            "<p><b>CORE:</b> x</p><p><b>CORE: Deep Strike, ", n, "</b></p><p><b>Shield of ", n, ":</b> This model shields all others &amp; itself.</p><p><b>Hit roll:</b> not an ability of this unit.</p><p><b>Short:</b> tiny</p>",
            '<div><div class="dsLeftCol">KEYWORDS: Infantry, ', F.col("p_type"), ',  infantry</div><div class="dsRightColKW">FACTION KEYWORDS: ', F.col("p_brand"), "</div></div></html>",
        ),
    )


@query("""SELECT p_partkey AS page_id, (p_size % 13) || '"' AS movement, nullif(p_size % 7, 0)::INT AS toughness, (p_size % 5 + 2) || '+' AS save, nullif(p_size, 0)::INT AS wounds, 6 AS leadership, NULL::INT AS objective_control FROM part""")
def sheet_stats(t: Tables) -> DataFrame:
    return datasheets.stats(_sheet(t))


@query("""SELECT p_partkey AS page_id, p_size * 5 AS points FROM part WHERE p_size * 5 BETWEEN 20 AND 500""")
def sheet_points(t: Tables) -> DataFrame:
    return datasheets.points(_sheet(t))


@query("""SELECT p_partkey AS page_id, slug, name, weapon_type, range, attacks, '3+' AS skill, '5' AS strength, ap AS armor_penetration, damage, abilities FROM part, LATERAL (
            SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-rifle' AS slug, p_name || ' rifle' AS name, 'ranged' AS weapon_type, '24"' AS range, (p_size % 4)::VARCHAR AS attacks, '-1' AS ap, '2' AS damage, ['[BLAST]'] AS abilities
            UNION ALL SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-blade', p_name || ' blade', 'melee', 'Melee', '2', '0', '1', ['[HEAVY]'])""")
def sheet_weapons(t: Tables) -> DataFrame:
    """A name in another case, a marker cell before the name, an ability in a span, and one grown on to a name."""
    return datasheets.weapons(_sheet(t), abilities=["blast", "heavy"])


@query("""SELECT p_partkey AS page_id, slug, name, ability_type, description FROM part, LATERAL (
            SELECT 'deep-strike' AS slug, 'Deep Strike' AS name, 'core' AS ability_type, 'CORE ability' AS description
            UNION ALL SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), p_name, 'core', 'CORE ability'
            UNION ALL SELECT 'shield-of-' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), 'Shield of ' || p_name, 'unit', 'This model shields all others & itself.')""")
def sheet_abilities(t: Tables) -> DataFrame:
    return datasheets.abilities(_sheet(t))


@query("""SELECT p_partkey AS page_id, ['INFANTRY', upper(p_type), upper(p_brand)] AS keywords FROM part""")
def sheet_keywords(t: Tables) -> DataFrame:
    return datasheets.keywords(_sheet(t))


@query("""SELECT p_partkey AS page_id, p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, (p_size % 3 + 4) || '+' AS invulnerable_save, CASE WHEN p_size * 5 BETWEEN 20 AND 500 THEN p_size * 5 END AS points, nullif(p_size % 7, 0)::INT AS toughness, false AS is_battleline FROM part""")
def sheet_units(t: Tables) -> DataFrame:
    return datasheets.units(_sheet(t)).select("page_id", "name", "slug", "invulnerable_save", "points", "toughness", "is_battleline")


def _faction(t: Tables) -> DataFrame:
    """A faction page per region; its nations are detachments, each with a rule, a stratagem and an enhancement, and two cards before any detachment."""
    anchor = lambda name: F.concat(F.lit('<a name="'), name, F.lit('"></a>'))
    lit, n, k = F.lit, F.col("n_name"), F.col("n_nationkey").cast("string")
    card = lambda name, cp, phase: F.concat(lit('<div class="str10Wrap"><div class="str10Name">'), name, lit('</div><div class="str10Border"><div class="str10CP">'), cp, lit('CP</div><div class="str10Text"><b>WHEN:</b> Your '), phase, lit(" phase.<br><br><b>TARGET:</b> One <span>unit</span>.<br><br><b>EFFECT:</b> It gains "), name, lit(".<br><br><b>RESTRICTIONS:</b> Once.</div></div></div>"))
    gift = lambda name, pts: F.concat(lit('<ul class="EnhancementsPts"><li><span>'), name, lit("</span> <span>"), pts, lit(" pts</span></li></ul><p>"), name, lit(" helps. REGION CHAMPION model only.</p>"))
    one = F.concat(
        anchor(n), lit("<h2>"), n, lit(' <img src="x"></h2><p class="ShowFluff legend">Lore of '), n, lit("</p>"), anchor(F.concat(lit("Detachment-Rule-"), k)), lit("<h2>Detachment Rule</h2>"), anchor(F.concat(lit("Rule-"), k)), lit('<h3 class="dsColorBgX">Rule of '), n, lit("</h3><p>Each of them fights.</p>"),
        anchor(F.concat(lit("Enhancements-"), k)), gift(F.concat(lit("Gift of "), n), k), anchor(F.concat(lit("Stratagems-"), k)), card(F.concat(lit("Plan of "), n), lit("2"), lit("Fight")),
    )
    body = t.nation.select("n_regionkey", "n_nationkey", one.alias("part")).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "part"))), lambda x: x["part"]), "").alias("parts"))
    top = F.concat(lit('<a name="Army-Rules"></a><h2>Army Rules</h2><div class="Columns2"><p class="ShowFluff">Long ago.</p><p>The army of '), F.col("r_name"), lit(' marches.</p></div><div class="clFl"></div>'), anchor(lit("Stratagems")), card(lit("Core Plan"), lit("1"), lit("Command")))
    return t.region.join(body, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("page_id"), F.concat(top, "parts").alias("html"))


@query("""SELECT r_regionkey AS page_id, 'Army Rules' || chr(10) || chr(10) || 'The army of ' || r_name || ' marches.' AS army_rules FROM region""")
def faction_rules(t: Tables) -> DataFrame:
    rule = factions.faction(_faction(t))
    return rule.select("page_id", F.concat(F.lit("Army Rules\n\n"), "army_rules").alias("army_rules"))


@query("""SELECT n_regionkey AS page_id, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS slug, n_name AS name, 'Rule of ' || n_name AS rule_name, 'Each of them fights.' AS rule_text, 'Lore of ' || n_name AS lore FROM nation""")
def faction_detachments(t: Tables) -> DataFrame:
    return factions.detachments(_faction(t)).drop("at")


@query("""SELECT n_regionkey AS page_id, n_name AS parent, 'Plan of ' || n_name AS name, '2' AS cp_cost, 'fight' AS phase, 'Your Fight phase.' AS "when", 'One unit.' AS target, 'It gains Plan of ' || n_name || '.' AS effect, 'Once.' AS restrictions FROM nation
          UNION ALL SELECT r_regionkey, NULL, 'Core Plan', '1', 'command', 'Your Command phase.', 'One unit.', 'It gains Core Plan.', 'Once.' FROM region""")
def faction_stratagems(t: Tables) -> DataFrame:
    return factions.stratagems(_faction(t)).drop("slug")


@query("""SELECT n_regionkey AS page_id, n_name AS parent, 'Gift of ' || n_name AS name, n_nationkey::INT AS points_cost, 'Gift of ' || n_name || ' helps. REGION CHAMPION model only.' AS description, n_name AS detachment FROM nation""")
def faction_enhancements(t: Tables) -> DataFrame:
    pages = _faction(t)
    return factions.attach_children(factions.detachments(pages), factions.enhancements(pages), ["page_id"], "name", "parent").drop("slug", "restrictions")


@query("""SELECT r_regionkey AS page_id, 'Core Plan' AS name, NULL AS detachment FROM region UNION ALL SELECT n_regionkey, 'Plan of ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation""")
def children_by_slug(t: Tables) -> DataFrame:
    """Stratagems met with every other detachment: the rest stay with the faction."""
    some = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("page_id"), F.col("n_name").alias("name"))
    return factions.attach_children(some, factions.stratagems(_faction(t)), ["page_id"], "name", "parent").select("page_id", "name", "detachment")


@query("""SELECT n_regionkey AS page_id, n_name AS anchor, true AS has_rule, true AS has_plan FROM nation""")
def faction_sections(t: Tables) -> DataFrame:
    s = factions.section_html(_faction(t))
    return s.select("page_id", "anchor", F.contains("html", F.concat(F.lit("Rule of "), "anchor")).alias("has_rule"), F.contains("html", F.concat(F.lit("Plan of "), "anchor")).alias("has_plan"))


@query("""SELECT n_nationkey AS page_id, kind, name, category, max_points, timing FROM nation, LATERAL (
            SELECT 'mission' AS kind, 'Take ' || upper(n_name[1:1]) || lower(n_name[2:]) AS name, NULL AS category, NULL::INT AS max_points, NULL AS timing
            UNION ALL SELECT 'secondary', 'Hold ' || upper(n_name[1:1]) || lower(n_name[2:]), CASE WHEN n_nationkey % 2 = 0 THEN 'both' ELSE 'tactical' END, greatest(n_nationkey, 5)::INT, 'Your turn.'
            UNION ALL SELECT 'gambit', 'Last Stand', NULL, NULL::INT, 'The end.')""")
def mission_cards(t: Tables) -> DataFrame:
    n, k = F.upper("n_name"), F.col("n_nationkey")
    html = page(
        '<div class="mission-card"><h3>TAKE ', n, "</h3><p>Score 3VP at the end of each turn.</p></div><div class=\"mission-card\"><h3>take ", F.lower(n), "</h3><p>Not in capitals, not a card.</p></div>",
        '<div class="secondary-x"><h4>HOLD ', n, "</h4><p>", F.when(k % 2 == 0, "FIXED or TACTICAL").otherwise("TACTICAL"), ": 5VP or ", k, "VP</p><p>WHEN: Your turn.</p></div>",
        '<div class="challenger"><h3>Last Stand</h3><p>WHEN: The end.</p><p>EFFECT: Nobody leaves the field.</p></div>',
    )
    return missions.cards(t.nation.select(k.alias("page_id"), html)).select("page_id", "kind", "name", "category", "max_points", "timing")


@query("""SELECT r_regionkey AS page_id, 'muster-armies' AS slug, 'Muster Armies' AS title, 'army_construction' AS category FROM region UNION ALL SELECT r_regionkey, 'determine-victor', 'Determine Victor', 'victory_conditions' FROM region WHERE r_regionkey > 1""")
def mission_rules(t: Tables) -> DataFrame:
    html = page('<a name="Muster-Armies-2"></a><h3>Muster Armies</h3><p>Each player of ', F.col("r_name"), ' musters an army of the agreed size.</p><a name="Determine-Victor"></a>', F.when(F.col("r_regionkey") > 1, F.concat(F.lit("<p>The player with the most victory points wins "), "r_name", F.lit(" at the end.</p>"))).otherwise("<p>Short.</p>"))
    return missions.matched_play_rules(t.region.select(F.col("r_regionkey").alias("page_id"), html)).drop("content")

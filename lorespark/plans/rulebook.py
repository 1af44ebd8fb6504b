"""Queries over rule functions: texts made of the star schema's names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import rules
from lorespark.functions import text as tx
from lorespark.operators import integrity
from lorespark.plans import Tables, query

RULES = [r"(?i)\beach time\b", r"(?i)\bre-roll\b"]


@query(r"""WITH x AS (SELECT p_partkey, p_name || ' ofthe neverfalter aBc NEVERFALTER 5 INFANTRYINFANTRYINFANTRY' AS t FROM part)
          SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(t, '(?i)neverfalter', 'Never Falter', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '(?i)\b(of)(the)\b', '\1 \2', 'g') AS normal,
                 replace(t, 'INFANTRYINFANTRYINFANTRY', 'INFANTRY') AS deduped, left(t, 9) AS short, p_size * 10 BETWEEN 20 AND 500 AS valid FROM part JOIN x USING (p_partkey)""")
def fixed_texts(t: Tables) -> DataFrame:
    c = F.concat("p_name", F.lit(" ofthe neverfalter aBc NEVERFALTER 5 INFANTRYINFANTRYINFANTRY"))
    return t.part.select("p_partkey", rules.normalize_text(c, {"neverfalter": "Never Falter"}).alias("normal"), rules.repeated_keywords(c).alias("deduped"), rules.truncate(c, 9).alias("short"), rules.valid_points(F.col("p_size") * 10).alias("valid"))


@query(r"""SELECT p_partkey, CASE WHEN contains(upper(p_type), 'BRASS') OR contains(upper(p_type), 'STEEL') THEN 'metal' WHEN contains(upper(p_type), 'SMALL') THEN 'small' ELSE 'ability' END AS kind,
                 p_name || ' X' AS name, CASE WHEN p_size % 3 = 0 THEN 'dQw4w9WgXcQ' WHEN p_size % 3 = 1 THEN 'abcdefghi_-' END AS video,
                 CASE WHEN p_size >= 45 THEN 'high' WHEN p_size >= 35 THEN CASE WHEN p_size % 2 = 0 THEN 'medium' ELSE 'high' END ELSE CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'high' END END AS boosted,
                 CASE WHEN p_size % 2 = 0 THEN 'low' ELSE 'medium' END AS lowered FROM part""")
def keyword_scalars(t: Tables) -> DataFrame:
    size, level = F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "low").otherwise("high")
    link = F.when(size % 3 == 0, "https://youtu.be/dQw4w9WgXcQ?t=3").when(size % 3 == 1, "abcdefghi_-").otherwise("no id")
    kinds = {"metal": ["brass", "steel"], "small": ["small"]}
    return t.part.select("p_partkey", rules.keyword_type(F.col("p_type"), kinds).alias("kind"), rules.keyword_name(F.concat(F.lit(r"\[ "), "p_name", F.lit("  X\\]"))).alias("name"), rules.video_id(link).alias("video"), rules.boost_confidence(level, size / 50).alias("boosted"), rules.lower_confidence(level).alias("lowered"))


@query(r"""SELECT p_partkey, 'Bitter End D6 of the Oath ' || p_size AS ability, p_name || ' x' AS composition, CASE WHEN p_size % 2 = 0 THEN 'Each time it rolls.' || chr(10) || chr(10) || 'More.' ELSE 'Lore.' || chr(10) || chr(10) || p_name END AS rules,
                 p_name AS sized, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN NULL ELSE 'Host of ' || p_name END AS detachment, p_size % 2 = 0 AS mission, CASE p_size % 3 WHEN 0 THEN 'chapter_approved_2025' WHEN 1 THEN 'leviathan' ELSE 'matched_play' END AS pack FROM part""")
def text_rules(t: Tables) -> DataFrame:
    n, size = F.col("p_name"), F.col("p_size")
    para = F.when(size % 2 == 0, F.concat(F.lit("Lore of "), n, F.lit(".\n\nEach time it rolls.\n\nMore."))).otherwise(F.concat(F.lit("Lore.\n\n"), n))
    host = F.when(size % 4 == 0, "# Not Found").when(size % 4 == 1, "Army Rules").otherwise(F.concat(F.lit("![i](u)Host of "), n, F.lit(" 2")))
    return t.part.select(
        "p_partkey", rules.clean_ability_name(F.concat(F.lit("BitterEndD6 ofthe Oath"), size)).alias("ability"), rules.clean_composition(F.concat(n, F.lit(" --- 160 70 |a| x 120"))).alias("composition"), rules.from_first_rule(para, RULES).alias("rules"),
        rules.without_suffix(F.concat(n, F.lit(" Strike Force")), ["Incursion", "Strike Force"]).alias("sized"), rules.detachment_name(host).alias("detachment"), rules.mission_name(F.when(size % 2 == 0, "TAKE & HOLD 2").otherwise("Take & Hold")).alias("mission"),
        rules.mission_pack(F.when(size % 3 == 0, "u/chapter-approved-2025-26/").when(size % 3 == 1, "u/leviathan").otherwise("u/other")).alias("pack"),
    )


@query(r"""SELECT n_nationkey, ['Iron Lances', 'Longbowmen', 'Pikemen'] AS units, CASE WHEN n_nationkey % 2 = 0 THEN 'riders' ELSE 'wolves' END AS first, CASE WHEN n_nationkey % 2 = 0 THEN ['riders', 'wolves'] ELSE ['wolves'] END AS labels,
                 ['captain', 'captain varo', 'captain varos'] AS variants FROM nation""")
def mention_rules(t: Tables) -> DataFrame:
    told = F.concat(F.lit("we run 5x Longbowmen and 3 Iron Lances, then the Pikemen of "), F.lower("n_name"))
    pats = [(r"\bgrey riders?\b", "riders"), (r"\bwol(?:f|ves)\b", "wolves")]
    fight = F.when(F.col("n_nationkey") % 2 == 0, "Wolves against Grey Riders").otherwise("the wolves win")
    return t.nation.select("n_nationkey", F.array_sort(rules.mentioned_units(told)).alias("units"), rules.first_label(fight, pats).alias("first"), rules.all_labels(fight, pats).alias("labels"), F.array_sort(F.filter(rules.unit_variants(F.lit("Captain Varo with Blade"), ["captain", "sergeant"]), lambda x: F.length(x) < 20)).alias("variants"))


@query(r"""SELECT n_nationkey, ['text', 'link', 'text', 'keyword', 'text', 'unit-keyword', 'text'] AS kinds, ['See ', n_name, ' and gain ', 'DEADLY BLOWS', ' near ', 'RIVER GUARDS', ' units'] AS contents, 'u' || n_nationkey AS target,
                 'Oath' AS rule, 'Old ' || n_name AS lore, 'Each time it fights.' || chr(10) || chr(10) || 'Then it rests.' AS effect, 'one TWO two' AS replaced FROM nation""")
def rich_texts(t: Tables) -> DataFrame:
    line = F.concat(F.lit("See ["), "n_name", F.lit("](u"), F.col("n_nationkey").cast("string"), F.lit(") and gain [DEADLY BLOWS] near RIVER GUARDS units"))
    rule = rules.army_rule(F.concat(F.lit("### Oath\n\nOld "), "n_name", F.lit("\n\nEach time it fights.\n\nThen it rests.\n\n| a | b |")), RULES)
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("one").alias("text")), F.struct(F.lit(4).alias("start"), F.lit(7).alias("end"), F.lit("TWO").alias("text")))
    s = rules.segments(line)
    return t.nation.select("n_nationkey", F.transform(s, lambda x: x["kind"]).alias("kinds"), F.transform(s, lambda x: x["content"]).alias("contents"), s[1]["target"].alias("target"), rule["name"].alias("rule"), rule["lore"].alias("lore"), rule["effect"].alias("effect"), rules.replace_spans(F.lit("abc def two"), spans).alias("replaced"))


_MARKS = ["(Stratagem)", "(ability)", "(rule)", "(reserves)", "(Detachment", "(resource)", "(reference)", "Stratagem / Ability", "ability/stratagem", "Resurgent Points", "Cult Ambush a token", "Token Guard", "(army ability)", "(cross reference note)", ""]


@query(f"""SELECT p_partkey, p_partkey % {len(_MARKS)} < 11 AS other, (p_partkey % {len(_MARKS)} <> 14) AS marked FROM part""")
def misclassified_names(t: Tables) -> DataFrame:
    """Eleven spellings that mark another thing than a unit, and four near misses."""
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (F.col("p_partkey") % len(_MARKS) + 1).cast("int"))
    return t.part.select("p_partkey", integrity.misclassified(F.concat_ws(" ", "p_name", mark)).alias("other"), (mark != "").alias("marked"))


@query(r"""SELECT c_custkey, list_filter(['blank', 'lowercase', 'too_long', 'markup', 'numbered', 'unfinished'], lambda x: (x = 'lowercase' AND c_custkey % 5 = 1) OR (x = 'too_long' AND c_custkey % 5 = 2) OR (x = 'markup' AND c_custkey % 5 = 3) OR (x = 'numbered' AND c_custkey % 5 = 4) OR (x = 'unfinished' AND c_custkey % 5 = 0)) AS faults FROM customer""")
def name_quality(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    name = F.when(k == 1, "all lower").when(k == 2, F.repeat(F.lit("Xy "), 40)).when(k == 3, "Left &amp; Right").when(k == 4, "Squad 12").otherwise("Host of the")
    return t.customer.select("c_custkey", integrity.name_faults(name).alias("faults"))


@query(r"""SELECT c_custkey, lower(trim(regexp_replace(c_name, '\s+', ' ', 'g'))) AS term, 'Customer' || substr(c_name, 9) AS titled, ['t-au-' || lower(c_mktsegment), 'tau-' || lower(c_mktsegment)] AS slugs, trim(split_part(c_name, '#', 1)) AS bare FROM customer""")
def name_scalars(t: Tables) -> DataFrame:
    slugs = tx.slug_variants(F.concat(F.lit("T'au "), "c_mktsegment"))
    return t.customer.select("c_custkey", tx.normalize_term(F.col("c_name")).alias("term"), tx.title_case(F.col("c_name")).alias("titled"), F.slice(slugs, 2, 2).alias("slugs"), tx.strip_parentheses(F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit(" (unit) "))).alias("bare"))

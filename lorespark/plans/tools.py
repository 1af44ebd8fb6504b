"""The catalogue's read functions over the star schema: nations are factions, suppliers units, regions keywords, parts weapons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import slugify
from lorespark.operators.catalog_api import Catalog
from lorespark.plans import Tables, query
from lorespark.plans.text import _DICE


def _catalog(t: Tables) -> Catalog:
    n, s = t.nation, t.supplier
    weapons = t.part.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", F.col("p_name").alias("name"), F.lit("ranged").alias("weapon_type"), F.lit("1").alias("range"), F.lit("2").alias("attacks"), F.lit("3").alias("damage"))
    links = t.lineitem.select(F.col("l_suppkey").alias("unit_id"), F.col("l_partkey").alias("weapon_id")).distinct()
    none = t.spark.createDataFrame([], "id bigint, name string, ability_type string, description string, faction_id bigint, slug string")
    return Catalog(
        t.spark,
        factions=n.select(F.col("n_nationkey").alias("id"), slugify(F.col("n_name")).alias("slug"), F.col("n_name").alias("name"), F.lit(False).alias("is_subfaction")),
        units=s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("faction_id"), F.lit('6"').alias("movement"), (F.col("s_suppkey") % 9).cast("int").alias("toughness"), F.lit("3+").alias("save"), F.lit(1).alias("wounds"), F.lit("6+").alias("leadership"), F.lit(1).alias("objective_control"), F.lit(50).alias("points_cost")),
        keywords=t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("faction").alias("keyword_type")),
        unit_keywords=s.select(F.col("s_suppkey").alias("unit_id"), (F.col("s_suppkey") % 5).alias("keyword_id")),
        detachments=n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Host of "), "n_name").alias("name"), F.col("n_nationkey").alias("faction_id")),
        weapons=weapons, unit_weapons=links, abilities=none, unit_abilities=t.spark.createDataFrame([], "unit_id bigint, ability_id bigint"), stratagems=none.select("id", "name", "faction_id"), enhancements=none.select("id", "name", F.col("faction_id").alias("detachment_id")),
    )


@query("""SELECT n_name AS name, 'tool' AS tool FROM nation""")
def tool_list_factions(t: Tables) -> DataFrame:
    return _catalog(t).list_factions().select("name", F.lit("tool").alias("tool"))


@query("""SELECT r_name AS chapter, count(DISTINCT s_suppkey) AS n_units, list_sort(list(DISTINCT s_name))[1:3] AS samples FROM supplier JOIN region ON s_suppkey % 5 = r_regionkey GROUP BY r_name""")
def tool_list_chapters(t: Tables) -> DataFrame:
    return _catalog(t).list_chapters()


@query("""SELECT n_name AS name, count(s_suppkey) AS n_units, 1::BIGINT AS n_detachments FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7' GROUP BY n_name""")
def tool_get_faction(t: Tables) -> DataFrame:
    return _catalog(t).get_faction("nation 7").select("name", "n_units", "n_detachments")


@query("""SELECT s_name AS name, n_name AS faction FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '1') AND s_suppkey % 5 = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') ORDER BY s_name, s_suppkey LIMIT 20""")
def tool_search_units(t: Tables) -> DataFrame:
    return _catalog(t).search_units("1", keyword="asia").select("name", "faction")


@query("""WITH u AS (SELECT * FROM supplier WHERE contains(lower(s_name), '3') ORDER BY s_suppkey LIMIT 1)
          SELECT s_name AS name, n_name AS faction, (s_suppkey % 9)::INT AS toughness, (SELECT list_sort(list(DISTINCT p_name)) FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = s_suppkey AND p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_name)) AS weapons, [r_name] AS keywords
          FROM u JOIN nation ON s_nationkey = n_nationkey JOIN region ON s_suppkey % 5 = r_regionkey""")
def tool_get_unit(t: Tables) -> DataFrame:
    u = _catalog(t).get_unit("3")
    return u.select("name", "faction", F.col("stats.toughness").alias("toughness"), F.transform("weapons", lambda w: w["name"]).alias("weapons"), F.transform("keywords", lambda w: w["name"]).alias("keywords"))


@query("""SELECT s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3'""")
def tool_list_valid_names(t: Tables) -> DataFrame:
    return _catalog(t).list_valid_names("units", "nation_3")


_TERMS = "SELECT unnest(['natoin 12', 'NATION-3', 'host of nation_4', 'zzzz', 'host nation 11']) AS term"


@query(_DICE.format(names="SELECT n_name AS name FROM nation UNION SELECT 'Host of ' || n_name FROM nation", terms=_TERMS) + """, b AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, name) AS r FROM s WHERE score >= 0.6)
          SELECT q.term, b.name, CASE WHEN b.name LIKE 'Host%' THEN 'detachments' WHEN b.name IS NOT NULL THEN 'factions' END AS category, CASE WHEN b.name LIKE 'Host of %' THEN substr(b.name, 9) END AS faction, floor(score * 100 + 0.5) / 100 AS confidence
          FROM (SELECT DISTINCT term FROM q) q LEFT JOIN b ON q.term = b.term AND r = 1""")
def tool_validate_terms(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(x,) for x in ("natoin 12", "NATION-3", "host of nation_4", "zzzz", "host nation 11")], "term string")
    return _catalog(t).validate_terms(terms, ["factions", "detachments"])


@query(_DICE.format(names="SELECT n_name AS name FROM nation UNION SELECT 'Host of ' || n_name FROM nation UNION SELECT s_name FROM supplier", terms="SELECT 'hosts of nation_1' AS term") + """,
          nn AS (SELECT n_name AS name, 'factions' AS category, NULL AS faction FROM nation UNION ALL SELECT 'Host of ' || n_name, 'detachments', n_name FROM nation UNION ALL SELECT DISTINCT s_name, 'units', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
          f AS (SELECT n.name, category, faction, floor(score * 100 + 0.5) / 100 AS c FROM s JOIN nn n ON s.name = n.name WHERE score >= 0.4 ORDER BY c DESC, n.name, category, faction LIMIT 10),
          r AS (SELECT name, category, faction, least(1.0, floor((c + CASE WHEN contains(lower(replace(faction, '_', '')), 'nation12') OR contains('nation12', lower(replace(faction, '_', ''))) THEN 0.2 ELSE 0 END) * 100 + 0.5) / 100)::DOUBLE AS relevance FROM f)
          SELECT *, count(*) FILTER (WHERE relevance >= 0.7) OVER () > 1 AS ambiguous FROM r""")
def tool_resolve_ambiguous(t: Tables) -> DataFrame:
    return _catalog(t).resolve_ambiguous_term("hosts of nation_1", hints=["NATION_12"]).select("name", "category", "faction", "relevance", "ambiguous")

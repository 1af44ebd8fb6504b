"""Queries of name checks, contents lists, ability texts, statuses of units and the catalogue's other read functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import rules, text
from lorespark.functions.text import slugify
from lorespark.operators import joins, reports, stages
from lorespark.operators.catalog_api import Catalog
from lorespark.plans import Tables, query
from lorespark.plans.games import _GAME, _games
from lorespark.scratch import Scratch
from lorespark.sources import pages
from lorespark.streaming import events as ev
from lorespark.streaming import game


@query("""SELECT n_regionkey::BIGINT AS page_id, n_name || CASE WHEN n_nationkey % 5 = 4 THEN ' & more' ELSE '' END AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'T''au-of-' ELSE '' END || n_name AS slug FROM nation WHERE n_nationkey % 5 IN (0, 3, 4)""")
def toc_units(t: Tables) -> DataFrame:
    """A contents list per region: plain links, links behind pictures of what is left out, repeated and escaped ones."""
    n, link = F.col("n_name"), lambda target, said: F.concat(F.lit('<a class="x" href="/x/datasheets#'), target, F.lit('">'), said, F.lit("</a>"))
    kind = F.col("n_nationkey") % 5
    entry = (
        F.when(kind == 1, F.concat(F.lit('<img src="/a/Legends_logo.png"> '), link(n, n)))
        .when(kind == 2, F.concat(F.lit("<img src='FW_logo3.png'/><span>"), link(n, n), F.lit("</span>")))
        .when(kind == 3, F.concat(F.lit('<img src="ok.png">'), link(n, n), link(n, F.lit("Another name")), link(F.lit(""), n)))
        .when(kind == 4, link(F.concat(F.lit("T%27au%20of%20"), n), F.concat(F.lit(" <span>"), n, F.lit("</span> &amp;\nmore"))))
        .otherwise(F.concat(link(n, n), F.lit('<a href="/other#x">no unit</a>')))
    )
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: F.concat(F.lit("<li>"), x["e"], F.lit("</li>"))), "")
    return pages.toc_entries(t.nation.groupBy(F.col("n_regionkey").cast("bigint").alias("page_id")).agg(html.alias("html"))).select("page_id", "name", "slug")


_KNOWN = ", ".join(f"'{k}'" for k in rules.WEAPON_ABILITIES)


@query(f"""WITH k AS (SELECT [{_KNOWN}] AS k), p AS (SELECT p_partkey, p_partkey % 24 AS a, (p_partkey // 24 + p_size) % 24 AS b, p_size FROM part)
           SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN [k[a + 1], k[b + 1]] WHEN a = b THEN [k[a + 1] || ' ' || p_size || '+'] ELSE [k[least(a, b) + 1], k[greatest(a, b) + 1] || ' ' || p_size || '+'] END AS abilities FROM p, k""")
def weapon_ability_lists(t: Tables) -> DataFrame:
    """Two abilities and a number grown together, or written with commas."""
    known = F.array(*[F.lit(k) for k in rules.WEAPON_ABILITIES])
    a, b = F.col("p_partkey") % 24, (F.floor(F.col("p_partkey") / 24) + F.col("p_size")) % 24
    name = lambda i: F.element_at(known, (i + 1).cast("int"))
    joined = lambda i: F.lower(F.regexp_replace(name(i), r"[\s-]", ""))
    said = F.when(F.col("p_partkey") % 7 == 0, F.concat_ws(",  ", name(a), name(b))).otherwise(F.concat(joined(b), joined(a), F.lit("/"), F.col("p_size").cast("string"), F.lit("+")))
    return t.part.select("p_partkey", rules.weapon_abilities(said).alias("abilities"))


@query("""SELECT n_nationkey, name, lore, effect FROM nation, LATERAL (SELECT n_name AS name, 'Lore of ' || n_name AS lore, 'It gains [' || n_name || ']. Twice.' AS effect
            UNION ALL SELECT 'Short ' || n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Only lore' END, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'An Ability of it' END
            UNION ALL SELECT 'Alone', NULL, '')""")
def sub_ability_rows(t: Tables) -> DataFrame:
    n = F.col("n_name")
    table = F.concat(F.lit("### Rule\n\n| "), n, F.lit("<br>Lore of "), n, F.lit("<BR/>It gains ["), n, F.lit("].<br>Twice. |\n| --- |\n| Short "), n, F.lit("<br>"), F.when(F.col("n_nationkey") % 2 == 0, "Only lore").otherwise("An Ability of it"), F.lit(" |\n|  Alone  |\n|   |"))
    return t.nation.select("n_nationkey", F.explode(rules.sub_abilities(table)).alias("s")).select("n_nationkey", "s.*")


def _names(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names that are misheard, cut, turned round or lengthened, and the official ones, in one scope for each size class."""
    known = t.part.select((F.col("p_partkey") % 3).alias("scope"), F.col("p_name").alias("official")).distinct()
    o = F.col("official")
    first, second = F.split_part(o, F.lit(" "), F.lit(1)), F.split_part(o, F.lit(" "), F.lit(2))
    forms = F.array(F.replace(o, F.lit("c"), F.lit("k")), F.concat(o, F.lit("s")), F.upper(o), second, F.concat_ws(" ", second, first))
    return known.select("scope", F.explode(forms).alias("name")).distinct(), known


@query()
def checked_names(t: Tables) -> DataFrame:
    names, known = _names(t)
    return reports.check_names(names, known).withColumn("confidence", F.round("confidence", 6))


@query()
def name_suggestions(t: Tables) -> DataFrame:
    names, known = _names(t)
    told = reports.name_suggestions(names, known)
    # Scores that differ by rounding alone may rank either way.
    return told.select("scope", "name", F.round("confidence", 6).alias("confidence")).groupBy("scope", "name").agg(F.array_sort(F.collect_list("confidence")).alias("scores"))


@query(f"""WITH {_GAME} SELECT game_id, unit_id,
             coalesce(arg_max(true, ts) FILTER (WHERE type = 'unit_moved'), false) AS advanced, bool_or(type = 'unit_shot') AS has_shot, bool_or(type = 'unit_destroyed') AS destroyed,
             min(ts) FILTER (WHERE type = 'unit_destroyed') AS gone FROM g GROUP BY game_id, unit_id""")
def unit_statuses(t: Tables) -> DataFrame:
    s = ev.unit_status(_games(t))
    first = _games(t).filter("type = 'unit_destroyed'").groupBy("game_id", "unit_id").agg(F.min("ts").alias("gone"))
    return s.join(first, ["game_id", "unit_id"], "left").select("game_id", "unit_id", "advanced", "has_shot", "destroyed", "gone")


@query("""SELECT status, n, failed FROM (SELECT 'done' AS status, count(*) AS n, 0::BIGINT AS failed FROM supplier WHERE s_suppkey % 10 <> 3
          UNION ALL SELECT 'failed', count(*), count(*) FROM (SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3))""")
def fanned_out(t: Tables) -> DataFrame:
    """A worker over batches of one row each, some of which fail: what it did and what went wrong."""

    def work(batch):
        if (batch["s_suppkey"] % 10 == 3).any():
            raise ValueError("three")
        return batch[["s_suppkey"]]

    before = t.spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    t.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        done = Scratch(t.spark, "fanned").write(game.fan_out(t.supplier.select("s_suppkey"), work, "s_suppkey bigint", 4), "done")
    finally:
        t.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return done.groupBy(F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") == "ValueError: three").alias("failed"))


@query("""SELECT * FROM (SELECT 0 AS stage, 'large' AS name, 'done' AS status, count(*) AS rows FROM supplier WHERE s_acctbal > 0
          UNION ALL SELECT 1, 'named', 'done', count(DISTINCT s_nationkey) FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 2, 'broken', 'failed', NULL UNION ALL SELECT 3, 'after', 'skipped', NULL)""")
def stage_artifacts(t: Tables) -> DataFrame:
    steps = [("large", lambda d: d.filter("s_acctbal > 0")), ("named", lambda d: d.select("s_nationkey").distinct()), ("broken", lambda d: d.select("no_such_column")), ("after", lambda d: d)]
    _, facts = stages.run_stages(t.spark, t.supplier, steps, f"{Scratch(t.spark, 'stages').root}/run")
    return facts.select("stage", "name", "status", "rows")


@query("""SELECT c_mktsegment || c_mktsegment AS said, c_mktsegment AS once, 'it''s ' || c_mktsegment || '''s' AS plain, count(*) AS n FROM customer GROUP BY ALL""")
def joined_keywords(t: Tables) -> DataFrame:
    seg = F.col("c_mktsegment")
    told = t.customer.groupBy(seg).agg(F.count(F.lit(1)).alias("n"))
    thrice = text.dedupe_keywords(F.concat(seg, seg, seg))
    return told.select(F.concat(seg, seg).alias("said"), thrice.alias("once"), text.normalize_apostrophes(F.concat(F.lit("it’s "), seg, F.lit("`s"))).alias("plain"), "n")


def _catalog(t: Tables) -> Catalog:
    """Parts as core rules, abilities, stratagems and enhancements, nations as factions, detachments and missions, conversations as questions."""
    p, n = t.part, t.nation
    key, size = F.col("p_partkey"), F.col("p_size")
    return Catalog(
        t.spark,
        factions=n.select(F.col("n_nationkey").cast("bigint").alias("id"), slugify(F.col("n_name")).alias("slug"), F.col("n_name").alias("name"), F.lit(False).alias("is_subfaction")),
        detachments=n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("Host of "), "n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("faction_id")),
        core_rules=p.select(key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.col("p_type").alias("content"), F.when(key % 3 > 0, size).alias("order_index")),
        stratagems=p.select(key.alias("id"), F.col("p_name").alias("name"), (key % 25).alias("faction_id"), F.when(key % 2 == 0, key % 25).alias("detachment_id"), F.col("p_size").cast("string").alias("cp_cost"), F.when(size % 3 == 0, "any").when(size % 3 == 1, "fight").otherwise("charge").alias("phase")),
        enhancements=p.select(key.alias("id"), F.col("p_name").alias("name"), (key % 25).alias("detachment_id"), size.alias("points_cost")),
        weapons=p.select(key.alias("id"), F.col("p_name").alias("name"), F.when(size % 2 == 0, "ranged").otherwise("melee").alias("weapon_type")),
        abilities=p.select(key.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.when(size % 2 == 0, "core").otherwise("unit").alias("ability_type"), (key % 25).alias("faction_id")),
        keywords=t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"), F.lit("faction").alias("keyword_type")),
        missions=n.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") > 2, "crusade").otherwise("open").alias("mission_type")),
        faqs=t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("category"), F.col("text").alias("question"), F.lit("").alias("answer"), (F.col("conv_id") % 25).alias("faction_id")),
    )


@query("""SELECT p_partkey AS id, p_name AS title FROM part WHERE p_brand = 'Brand#12' AND (contains(lower(p_name), 'l') OR contains(lower(p_type), 'l'))""")
def tool_core_rules(t: Tables) -> DataFrame:
    return _catalog(t).get_core_rules("Brand#12", "L").select("id", "title")


@query("""SELECT 'Host of ' || n_name AS name FROM nation WHERE n_name = 'NATION_7'""")
def tool_detachments(t: Tables) -> DataFrame:
    return _catalog(t).get_detachments("nation 7").select("name")


@query("""SELECT 'Host of NATION_8' AS name, (SELECT list_sort(list(p_name || ' ' || p_size)) FROM part WHERE p_partkey % 25 = 8 AND p_partkey % 2 = 0) AS stratagems, (SELECT list_sort(list(p_name || ' ' || p_size)) FROM part WHERE p_partkey % 25 = 8) AS enhancements""")
def tool_detachment_details(t: Tables) -> DataFrame:
    one = _catalog(t).get_detachment_details("nation-8", "host")
    short = lambda c, x: F.array_sort(F.transform(c, lambda r: F.concat_ws(" ", r["name"], r[x].cast("string"))))
    return one.select("name", short("stratagems", "cp_cost").alias("stratagems"), short("enhancements", "points_cost").alias("enhancements"))


@query("""SELECT p_partkey AS id, 'Host of NATION_6' AS detachment FROM part WHERE p_partkey % 25 = 6 AND p_partkey % 2 = 0 AND p_size % 3 < 2""")
def tool_stratagems(t: Tables) -> DataFrame:
    return _catalog(t).get_stratagems("NATION_6", "host of", "fight").select("id", "detachment")


@query("""SELECT p_partkey AS id, 'Host of NATION_9' AS detachment FROM part WHERE p_partkey % 25 = 9""")
def tool_enhancements(t: Tables) -> DataFrame:
    return _catalog(t).get_enhancements("NATION_9").select("id", "detachment")


@query("""SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'gear') AND p_size % 2 = 0 ORDER BY p_name, p_partkey LIMIT 20""")
def tool_weapons(t: Tables) -> DataFrame:
    return _catalog(t).search_weapons("Gear", "ranged").select("id")


@query("""SELECT p_partkey AS id FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_size % 2 = 1 ORDER BY p_name, p_partkey LIMIT 20""")
def tool_abilities(t: Tables) -> DataFrame:
    return _catalog(t).search_abilities("ring", "unit").select("id")


@query("""SELECT r_name AS name, 'faction' AS keyword_type FROM region WHERE lower(r_name) = 'asia'""")
def tool_keyword(t: Tables) -> DataFrame:
    return _catalog(t).get_keyword_info("Asia").select("name", "keyword_type")


@query("""SELECT n_name AS name FROM nation WHERE n_regionkey > 2""")
def tool_missions(t: Tables) -> DataFrame:
    return _catalog(t).get_missions("crusade").select("name")


@query("""SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id % 25 = 4 AND (contains(lower(text), 'an') OR contains(lower(role), 'an')) ORDER BY id LIMIT 10""")
def tool_faqs(t: Tables) -> DataFrame:
    return _catalog(t).search_faqs("an", "nation 4").select("id")


@query("""SELECT e.event_id, s.opened FROM (SELECT *, event_id % 2 AS half FROM events WHERE event_type <> 'signup') e
          ASOF LEFT JOIN (SELECT user_id, event_id % 2 AS half, ts, event_id AS opened FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.half = s.half AND e.ts >= s.ts""")
def events_in_intervals(t: Tables) -> DataFrame:
    """Each event with the interval that holds it: signups of its user and half open them."""
    e = t.events.withColumn("half", F.col("event_id") % 2)
    starts = e.filter("event_type = 'signup'").select("user_id", "half", F.col("ts").alias("since"), F.col("event_id").alias("opened"))
    return joins.into_intervals(e.filter("event_type <> 'signup'"), starts, ["user_id", "half"], "ts", "since", ["opened"]).select("event_id", "opened")

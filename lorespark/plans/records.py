"""Queries over stores, snapshots, catalogue entries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import etl, merge, reports
from lorespark.plans import Tables, query
from lorespark.sources import catalog


@query("""WITH d AS (SELECT DISTINCT upper(p_type) AS u FROM part WHERE p_size > 25), l AS (SELECT DISTINCT p_partkey, upper(p_type) AS u FROM part WHERE length(p_type) >= 2)
          SELECT count(DISTINCT l.u) FILTER (WHERE d.u IS NULL) AS created, count(*) AS links, count(DISTINCT p_partkey) AS parts FROM l LEFT JOIN d ON l.u = d.u""")
def resolved_keys(t: Tables) -> DataFrame:
    """Types of large parts are the dimension; every part's type, in lower case, is resolved or created."""
    dim = t.part.filter("p_size > 25").select("p_type").distinct().select(F.xxhash64(F.lit("dim"), "p_type").alias("type_id"), F.col("p_type").alias("name"))
    full, links = etl.resolve_keys(t.part.select("p_partkey", F.lower("p_type").alias("name")), dim, "name", "type_id")
    n = full.count() - dim.count()
    return links.agg(F.lit(n).cast("bigint").alias("created"), F.count(F.lit(1)).alias("links"), F.count_distinct("p_partkey").alias("parts"))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN 'success' ELSE 'pending' END AS status FROM supplier""")
def frontier_status(t: Tables) -> DataFrame:
    f = t.supplier.select("s_suppkey", "s_nationkey", F.lit("pending").alias("status"))
    done = t.nation.filter("n_nationkey < 5").select(F.col("n_nationkey").alias("s_nationkey"), F.lit("success").alias("status"))
    return etl.set_status(f, done, "s_nationkey", "status").drop("s_nationkey")


@query("""SELECT url, sha256(html) AS content_hash, CASE WHEN page_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN page_id % 3 = 0 THEN 'timeout' END AS error FROM pages UNION ALL SELECT 'old', 'x', 'success', NULL""")
def run_log(t: Tables) -> DataFrame:
    old = t.spark.createDataFrame([("old", "x", "success", None)], "url string, content_hash string, status string, error string").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    got = t.pages.withColumn("error", F.when(F.col("page_id") % 3 == 0, "timeout"))
    return etl.append_log(old, got, F.lit("2024-02-01").cast("timestamp")).drop("at")


@query("""WITH b AS (SELECT p_brand AS k, count(*) AS n, list_sort(list(DISTINCT p_type)) AS m FROM part WHERE p_size < 30 GROUP BY 1), a AS (SELECT p_brand AS k, count(*) AS n, list_sort(list(DISTINCT p_type)) AS m FROM part WHERE p_size > 20 GROUP BY 1),
          j AS (SELECT coalesce(b.k, a.k) AS p_brand, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, list_sort(list_filter(coalesce(a.m, []), lambda x: NOT list_contains(coalesce(b.m, []), x))) AS c, list_sort(list_filter(coalesce(b.m, []), lambda x: NOT list_contains(coalesce(a.m, []), x))) AS w FROM b FULL JOIN a ON b.k = a.k)
          SELECT p_brand, delta, len(c)::INT AS n_came, len(w)::INT AS n_went, c[1:5] AS came, w[1:5] AS went FROM j""")
def snapshot_members(t: Tables) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp")
    shot = lambda cond: etl.snapshot(t.part.filter(cond), ["p_brand"], "p_type", at)
    return etl.diff_members(shot("p_size < 30"), shot("p_size > 20"), "p_brand")


@query("""SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY p_brand""")
def lookup_lists(t: Tables) -> DataFrame:
    return etl.lookup_lists(t.part, "p_brand", "p_name")


@query("""WITH o AS (SELECT p_name AS alias, p_type AS kind, CASE WHEN p_size > 10 THEN p_brand END AS scope, p_partkey AS canonical FROM part WHERE p_partkey % 2 = 0), i AS (SELECT upper(p_name) AS alias, p_type AS kind, CASE WHEN p_size > 10 THEN p_brand END AS scope, p_partkey AS canonical FROM part WHERE p_partkey % 3 = 0),
          n AS (SELECT *, row_number() OVER (PARTITION BY lower(alias), kind, scope ORDER BY alias, kind, scope, canonical) AS r FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE lower(o.alias) = lower(i.alias) AND o.kind = i.kind AND o.scope IS NOT DISTINCT FROM i.scope))
          SELECT * FROM o UNION ALL SELECT alias, kind, scope, canonical FROM n WHERE r = 1""")
def imported_mappings(t: Tables) -> DataFrame:
    rows = lambda name, cond: t.part.filter(cond).select(name.alias("alias"), F.col("p_type").alias("kind"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("scope"), F.col("p_partkey").alias("canonical"))
    return etl.import_mappings(rows(F.col("p_name"), "p_partkey % 2 = 0"), rows(F.upper("p_name"), "p_partkey % 3 = 0"), ["alias", "kind", "scope"])


@query("""SELECT 'ATLANTIS' AS r_name UNION ALL SELECT 'LEMURIA'""")
def expected_missing(t: Tables) -> DataFrame:
    return etl.expected_missing(["ASIA", "ATLANTIS", "EUROPE", "LEMURIA"], t.region, "r_name")


@query("""SELECT count(*) AS entries, sum(length(html))::BIGINT AS characters, min(page_id) AS oldest, max(page_id) AS newest FROM pages""")
def cache_stats(t: Tables) -> DataFrame:
    return etl.cache_stats(t.pages, "html", "page_id")


@query("""SELECT 'lore://parents/' || lower(r_name) AS uri, r_name AS name FROM region UNION ALL SELECT 'lore://parents/' || lower(r_name) || '/nations/' || n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def resource_uris(t: Tables) -> DataFrame:
    kids = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lower("r_name").alias("parent"), F.col("n_nationkey").cast("string").alias("slug"), F.col("n_name").alias("name"))
    return etl.resource_uris("lore", t.region.select(F.lower("r_name").alias("slug"), F.col("r_name").alias("name")), {"nations": kids})


def _links(t: Tables) -> DataFrame:
    """A unit per supplier of a nation's catalogue, shown always, by a flag, by a gate, or by something unknown."""
    k = F.col("s_suppkey") % 4
    cond = lambda kind, value, child: F.array(F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value"), F.lit(child).alias("child_id")))
    return t.supplier.select(F.col("s_nationkey").cast("string").alias("catalogue"), F.col("s_name").alias("name"), F.when(k == 1, cond("lessThan", "1", "flag-a")).when(k == 2, cond("atLeast", "1", "gate")).when(k == 3, cond("equalTo", "5", "other")).alias("conditions"), F.lit("selectionEntry").alias("type"), (F.col("s_suppkey") % 11 == 0).alias("hidden"))


@query("""SELECT s_nationkey::VARCHAR AS catalogue, s_name AS name, CASE WHEN s_suppkey % 4 = 1 THEN 'Allies A' END AS ally_group FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 4 <> 3 AND NOT contains(s_name, '7')""")
def ally_conditions(t: Tables) -> DataFrame:
    flags = t.spark.createDataFrame([("flag-a", "lessThan", "1", "Allies A"), ("flag-b", "lessThan", "1", "Allies B")], "child_id string, type string, value string, ally_group string")
    return catalog.ally_conditions(catalog.visible_links(_links(t), ["7"]), flags, "gate")


@query("""WITH u AS (SELECT s_nationkey AS k, s_name AS name, s_suppkey % 4 = 1 AS ally FROM supplier WHERE s_suppkey % 11 <> 0 AND s_suppkey % 4 <> 3)
          SELECT n_nationkey::VARCHAR AS catalogue, d AS detachment, list_sort(list(DISTINCT name)) AS units FROM nation, (VALUES ('Alone', false), ('Joined', true)) v(d, joined) JOIN u ON u.k = n_nationkey AND (joined OR NOT ally) GROUP BY ALL""")
def detachment_units(t: Tables) -> DataFrame:
    flags = t.spark.createDataFrame([("flag-a", "lessThan", "1", "Allies A")], "child_id string, type string, value string, ally_group string")
    allies = catalog.ally_conditions(catalog.visible_links(_links(t), []), flags, "gate")
    each = F.explode(F.array(F.struct(F.lit("Alone").alias("detachment"), F.array().cast("array<string>").alias("ally_groups")), F.struct(F.lit("Joined").alias("detachment"), F.array(F.lit("Allies A")).alias("ally_groups")))).alias("d")
    dets = t.nation.select(F.col("n_nationkey").cast("string").alias("catalogue"), each).select("catalogue", "d.*")
    return catalog.detachment_units(allies, dets)


@query("""SELECT id, alias FROM (SELECT 'n-' || n_nationkey AS id, lower(n_name) AS alias FROM nation UNION SELECT 'n-' || n_nationkey, 'n ' || n_nationkey FROM nation UNION SELECT 'n-' || n_nationkey, 'the ' || n_nationkey FROM nation WHERE n_nationkey < 9)""")
def faction_aliases(t: Tables) -> DataFrame:
    f = t.nation.select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    known = t.nation.filter("n_nationkey < 9").select(F.col("n_name").alias("name"), F.concat(F.lit("The "), F.col("n_nationkey").cast("string")).alias("alias"))
    return catalog.faction_aliases(f, known)


@query("""SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN ' [Legends]' ELSE '' END AS name, list_sort(list_distinct(['a' || n_nationkey, 'old' || n_nationkey] || CASE WHEN n_nationkey % 2 = 0 THEN [lower(n_name)] ELSE [] END)) AS aliases FROM nation""")
def clean_aliases(t: Tables) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey").cast("string")
    official = t.nation.select(F.concat(n, F.when(F.col("n_nationkey") % 2 == 0, " [Legends]").otherwise("")).alias("name"))
    new = t.nation.select(F.upper(n).alias("unit"), F.explode(F.array(F.concat(F.lit(" A"), k), n, F.lit(" "))).alias("alias")).union(t.region.select("r_name", F.lit("x")))
    old = t.nation.select(n.alias("unit"), F.explode(F.array(F.concat(F.lit("old"), k), F.concat(F.lit("a"), k))).alias("alias"))
    return catalog.clean_aliases(new, old, official)


@query("""SELECT n_regionkey::VARCHAR AS "group", count(*)::INT AS n, max('alias ' || n_nationkey) AS top FROM nation GROUP BY 1""")
def batch_results(t: Tables) -> DataFrame:
    lines = t.nation.select(F.concat(F.col("n_regionkey").cast("string"), F.lit(":"), F.col("n_nationkey").cast("string")).alias("custom_id"), F.create_map(F.col("n_name"), F.array(F.concat(F.lit("alias "), F.col("n_nationkey").cast("string")))).alias("aliases"))
    r = catalog.batch_results(lines)
    return r.select("group", F.size("results").alias("n"), F.array_max(F.flatten(F.map_values("results"))).alias("top"))


@query("""SELECT count(*) FILTER (WHERE event_type = 'view') AS info, count(*) FILTER (WHERE event_type = 'click') AS warning, count(*) FILTER (WHERE event_type = 'error') AS error, 0::BIGINT AS critical, 1 AS exit_code FROM events""")
def alert_levels(t: Tables) -> DataFrame:
    level = F.when(F.col("event_type") == "view", "info").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "error", "error")
    return reports.alert_summary(t.events.select(level.alias("level")))


@query("""WITH c AS (SELECT p_type AS scope, p_name AS official, max(p_size) AS db_points FROM part WHERE p_size > 8 GROUP BY ALL), u AS (SELECT p_partkey, p_type AS scope, CASE WHEN p_size % 3 = 0 THEN upper(p_name) WHEN p_size % 3 = 1 THEN substr(p_name, 2, 6) ELSE p_name || ' (ability)' END AS name FROM part)
          SELECT p_partkey, official, db_points AS points FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN lower(name) = lower(official) THEN 0 ELSE 1 END, length(official), official) AS n
            FROM u JOIN c ON u.scope = c.scope AND contains(lower(official), lower(name)) WHERE NOT contains(name, '(ability')) WHERE n = 1""")
def enriched_units(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") % 3 == 0, F.upper("p_name")).when(F.col("p_size") % 3 == 1, F.substring("p_name", 2, 6)).otherwise(F.concat("p_name", F.lit(" (ability)")))
    u = t.part.select("p_partkey", F.col("p_type").alias("scope"), name.alias("name"), F.lit(None).cast("int").alias("points"))
    c = t.part.filter("p_size > 8").groupBy(F.col("p_type").alias("scope"), F.col("p_name").alias("official")).agg(F.max("p_size").alias("db_points"))
    return reports.enrich_units(u, c).select("p_partkey", "official", "points")


@query(r"""WITH m AS (SELECT p_brand AS report, p_partkey AS place, lower(p_name) AS mention, [p_size, p_size + 5] AS seconds FROM part WHERE p_partkey % 3 = 0), e AS (SELECT p_partkey, p_brand AS report, lower(p_name) AS name, CASE WHEN p_size > 45 THEN 1::INT END AS ts FROM part WHERE p_partkey % 3 = 1),
          w AS (SELECT e.*, m.place, m.seconds, m.mention, list_filter(string_split(e.name, ' '), lambda x: length(x) > 2) AS a, list_filter(string_split(m.mention, ' '), lambda x: length(x) > 2) AS b FROM e JOIN m ON e.report = m.report),
          k AS (SELECT *, CASE WHEN name = mention THEN 0 WHEN contains(name, mention) OR contains(mention, name) OR (len(list_intersect(a, b)) >= 1 AND 2 * len(list_intersect(a, b)) >= least(len(a), len(b))) THEN 1 END AS tier FROM w),
          f AS (SELECT p_partkey, arg_min(seconds[1], (tier, place)) AS s, 2 AS mention_count FROM k WHERE tier IS NOT NULL GROUP BY p_partkey)
          SELECT e.p_partkey, coalesce(e.ts, s)::INT AS ts, mention_count FROM e LEFT JOIN f ON e.p_partkey = f.p_partkey""")
def filled_mentions(t: Tables) -> DataFrame:
    m = t.part.filter("p_partkey % 3 = 0").select(F.col("p_brand").alias("report"), F.col("p_partkey").alias("place"), F.lower("p_name").alias("mention"), F.array(F.col("p_size"), F.col("p_size") + 5).alias("seconds"))
    e = t.part.filter("p_partkey % 3 = 1").select("p_partkey", F.col("p_brand").alias("report"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 45, F.lit(1)).cast("bigint").alias("ts"))
    return reports.fill_mentions(e, m).select("p_partkey", F.col("ts").cast("int").alias("ts"), "mention_count")


@query("""SELECT report, colloquial, CASE WHEN p_size % 4 = 0 THEN 'fixed ' || p_name ELSE p_name END AS official FROM (SELECT p_brand AS report, p_partkey AS colloquial, p_name, p_size FROM part) WHERE p_size % 4 <> 1 AND (p_size % 4 = 0 AND report >= 'Brand#3' OR p_size % 4 <> 0 AND (report >= 'Brand#3' OR p_size > 25))""")
def checked_mappings(t: Tables) -> DataFrame:
    """A quarter of the names is corrected, a quarter of a dropped kind; brands below 3 know the names of their larger parts alone."""
    p = t.part.select(F.col("p_brand").alias("report"), F.col("p_partkey").alias("colloquial"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("official"), "p_size", "p_name")
    v = p.filter("p_size % 4 < 2").select("official", F.concat(F.lit("fixed "), "official").alias("match"), F.when(F.col("p_size") % 4 == 1, "weapon").otherwise("unit").alias("kind"), F.lit(0.8).alias("score"))
    names = p.filter("report < 'Brand#3' and p_size > 25").select("report", F.upper("official").alias("name"))
    out = reports.check_mappings(p.select("report", "colloquial", "official"), v, names, ["weapon", "ability", "keyword"])
    return out.join(p.select("report", "colloquial", F.col("p_name").alias("n")), ["report", "colloquial"]).select("report", "colloquial", F.when(F.startswith("official", F.lit("fixed ")), F.concat(F.lit("fixed "), "n")).otherwise(F.col("n")).alias("official"))


@query("""SELECT c_nationkey AS report, c_custkey AS place, CASE c_custkey % 4 WHEN 0 THEN 'HOST OF ' || upper(n_name) WHEN 1 THEN 'Host of ' || n_name WHEN 2 THEN 'Unknown' ELSE 'kept' END AS detachment FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def checked_detachments(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, F.concat(F.lit("HOST OF "), F.upper("n_name"))).when(k == 1, F.lit("host")).when(k == 2, F.lit("nothing like it")).otherwise("kept")
    players = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("report"), F.col("c_custkey").alias("place"), F.when(k == 3, "no faction").otherwise(F.col("n_name")).alias("faction"), said.alias("detachment"))
    return reports.check_detachments(players, t.nation.select(F.col("n_name").alias("faction"), F.concat(F.lit("Host of "), "n_name").alias("detachment"))).drop("faction")


@query("""SELECT n_regionkey AS report, n_nationkey::INT AS place, CASE WHEN r = 1 THEN 'Long Host of R' || n_regionkey WHEN r = 2 THEN 'Host' ELSE 'Unknown' END AS detachment FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)""")
def repaired_detachments(t: Tables) -> DataFrame:
    """A transcript names two detachments of the region's faction: the longer goes to its first nation, the other to the second."""
    reg = lambda c: F.concat(F.lit("R"), F.col(c).cast("string"))
    players = t.nation.select(F.col("n_regionkey").alias("report"), F.col("n_nationkey").cast("int").alias("place"), reg("n_regionkey").alias("faction"), F.lit("Unknown").alias("detachment"))
    told = t.region.select(F.col("r_regionkey").alias("report"), F.concat(F.lit("they play a long host of "), F.lower(reg("r_regionkey")), F.lit(" today")).alias("text"))
    dets = t.region.select(reg("r_regionkey").alias("faction"), F.explode(F.array(F.lit("Host"), F.concat(F.lit("Long Host of "), reg("r_regionkey")), F.lit("Never Named"))).alias("detachment"))
    return reports.repair_detachments(players, told, dets).drop("faction")


@query("""SELECT term, name, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, name) AS rank FROM (
            SELECT p_brand AS term, p_name AS name, max(greatest(p_size / 50.0, CASE WHEN p_size % 2 = 0 THEN p_size / 40.0 ELSE 0 END)) AS score FROM part GROUP BY ALL)) WHERE rank <= 5""")
def merged_suggestions(t: Tables) -> DataFrame:
    one = t.part.select(F.col("p_brand").alias("term"), F.col("p_name").alias("name"), (F.col("p_size") / 50.0).alias("score"))
    two = t.part.filter("p_size % 2 = 0").select(F.col("p_brand").alias("term"), F.col("p_name").alias("name"), (F.col("p_size") / 40.0).alias("score"))
    return merge.suggestions([one, two], "term", "name")


@query("""SELECT alias, arg_max(canonical, (r, -k)) AS canonical FROM (SELECT lower(p_name) AS alias, p_brand AS canonical, 1 AS r, 0 AS k FROM part WHERE p_size > 25 UNION ALL SELECT lower(p_name), p_brand, 2, 0 FROM part WHERE p_size <= 5) GROUP BY alias HAVING count(DISTINCT canonical) FILTER (WHERE r = 2) = 1""")
def alias_dictionary(t: Tables) -> DataFrame:
    """Aliases of two sources, where the second one knows exactly one name for them."""
    rows = lambda cond: t.part.filter(cond).select(F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical"))
    sure = rows("p_size <= 5").groupBy(F.lower("alias").alias("alias")).agg(F.count_distinct("canonical").alias("n")).filter("n = 1").select("alias")
    return catalog.dictionary([(1, rows("p_size > 25")), (2, rows("p_size <= 5"))]).join(sure, "alias", "left_semi")

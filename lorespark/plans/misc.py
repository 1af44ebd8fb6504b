"""Queries over the smaller operators: hierarchies, term lists, caches, gated detection, sorted and split lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import text as tx
from lorespark.operators import etl, integrity, match, transcript
from lorespark.plans import Tables, query
from lorespark.sources import pages


@query("""WITH n AS (SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey >= 5 THEN n_nationkey % 5 END AS parent FROM nation) SELECT p.name, count(c.id) AS children, list_sort(list(c.name) FILTER (WHERE c.name IS NOT NULL)) AS names FROM n p LEFT JOIN n c ON c.parent = p.id WHERE p.parent IS NULL GROUP BY p.name""")
def hierarchy(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") >= 5, F.col("n_nationkey") % 5).alias("parent"))
    kids = n.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("children"), F.array_sort(F.collect_list("name")).alias("names"))
    return n.filter("parent is null").join(kids, "id", "left").select("name", F.coalesce("children", F.lit(0)).alias("children"), "names")


@query(r"""SELECT term FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS term FROM documents UNION SELECT unnest(regexp_extract_all(text, '[0-9]+%')) FROM documents UNION SELECT lower(r_name) FROM region)""")
def rule_terms(t: Tables) -> DataFrame:
    """Terms that patterns find in texts, and titles in lower case, each once."""
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), 0) for p in ("[A-Z][a-z]{6,}", "[0-9]+%")])
    terms = t.documents.select(F.explode(found).alias("term")).union(t.region.select(F.lower("r_name")))
    return terms.distinct()


@query(r"""SELECT p_partkey FROM part WHERE NOT regexp_matches(p_name, '(?i)^(red|blue)|\d|rod$')""")
def corrupted_names(t: Tables) -> DataFrame:
    return t.part.filter(~integrity.any_of(F.col("p_name"), ["^(?:red|blue)", r"\d", "rod$"])).select("p_partkey")


@query(r"""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract_all(html, '\]\(([^)\s]+)\)', 1) || regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages), u AS (SELECT DISTINCT page_id, site, unnest(l) AS href FROM h),
          a AS (SELECT page_id, site, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS target FROM u) SELECT DISTINCT page_id, target FROM a WHERE starts_with(target, site || '/') OR target = site""")
def same_site_links(t: Tables) -> DataFrame:
    site = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    found = pages.page_links(t.pages).join(t.pages.select("page_id", site.alias("site")), "page_id")
    return found.filter(F.startswith("target", F.concat("site", F.lit("/"))) | (F.col("target") == F.col("site"))).select("page_id", "target").distinct()


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate > timestamp '1998-01-01' - INTERVAL 7 DAY AND o_orderdate < timestamp '1998-03-01'""")
def fresh_entries(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("at", F.col("o_orderdate").cast("timestamp")).filter("o_orderdate < timestamp'1998-03-01 00:00:00'")
    return etl.fresh(rows, "at", F.lit("1998-01-01 00:00:00").cast("timestamp"), 7 * 86400).select("o_orderkey")


@query("""SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 10 = s_suppkey WHERE p_size > 40""")
def returned_keys(t: Tables) -> DataFrame:
    """Children wired to the keys that their parents were given: both sides derive them from the natural key."""
    parents = t.supplier.select(etl.surrogate_key("s_name").alias("id"), "s_suppkey", "s_name")
    names = t.supplier.select("s_suppkey", "s_name").withColumnRenamed("s_suppkey", "k")
    kids = t.part.filter("p_size > 40").select("p_partkey", (F.col("p_partkey") % 10).alias("k")).join(names, "k").select("p_partkey", etl.surrogate_key("s_name").alias("id"))
    return kids.join(parents, "id").select("p_partkey", "s_suppkey")


@query("""SELECT conv_id, turn, term, 'W' || term AS canonical, CASE term WHEN 'with' THEN 'prep' ELSE 'word' END AS kind FROM (
            SELECT DISTINCT conv_id, turn, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ')) AS term, text FROM conversations)
          WHERE term IN ('the', 'with') OR (term = 'les' AND contains(lower(text), 'que'))""".replace("\\\\", "\\"))
def typed_mentions(t: Tables) -> DataFrame:
    """One replacement for each term, the first type's; gated terms only where their word stands."""
    words = [("the", "Wthe", "word"), ("with", "Wwith", "prep"), ("with", "Xwith", "word"), ("les", "Wles", "gate"), ("the", "Zthe", "other")]
    d = t.spark.createDataFrame(words, "term string, canonical string, kind string")
    found = transcript.detect_types(t.conversations.select("conv_id", "turn", "text"), F.broadcast(d), ["conv_id", "turn"], ["prep", "word", "gate"], {"gate": "que"})
    return found.withColumn("kind", F.when(F.col("kind") == "gate", "word").otherwise(F.col("kind")))


@query("""SELECT p_partkey, length(p_name) + 6 AS start, 2 * length(p_name) + 7 AS "end", p_name AS name FROM part WHERE p_size < 10
          UNION ALL SELECT p_partkey, 1, length(p_name) + 1, p_name FROM part WHERE p_size < 10""")
def entity_spans(t: Tables) -> DataFrame:
    """Every small part's name in brackets, and its plural after a comma."""
    p = t.part.filter("p_size < 10").select("p_partkey", F.concat(F.lit("("), F.upper("p_name"), F.lit(") or "), "p_name", F.lit("s, then")).alias("text"))
    return transcript.entity_spans(p, t.part.select("p_name").distinct(), ["p_partkey"], "text", "p_name").withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})


@query("""SELECT c_custkey, '2025-06-12' AS day FROM customer WHERE c_custkey % 6 < 4 UNION ALL SELECT c_custkey, '2025-06-01' FROM customer WHERE c_custkey % 6 = 4 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 6 = 5""")
def effective_dates(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 6
    said = F.when(k == 0, "from 12 June 2025 on").when(k == 1, "June 12, 2025").when(k == 2, "as of 12/06/2025").when(k == 3, "2025-06-12").when(k == 4, "in June 2025").otherwise("soon")
    return t.customer.select("c_custkey", pages.effective_date(said).cast("date").cast("string").alias("day"))


@query("""SELECT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'core' ELSE 'unit' END AS kind, list_sort(list(n_name)) AS names FROM nation WHERE n_nationkey <> 7 GROUP BY ALL""")
def split_by_type(t: Tables) -> DataFrame:
    generic = t.spark.createDataFrame([("NATION_7",)], "n_name string")
    rows = t.nation.join(generic, "n_name", "left_anti").withColumn("kind", F.when(F.col("n_nationkey") % 3 == 0, "core").otherwise("unit"))
    return rows.groupBy("n_regionkey", "kind").agg(F.array_sort(F.collect_list("n_name")).alias("names"))


@query("""SELECT n_name, row_number() OVER (ORDER BY n_nationkey % 4 = 0 DESC, n_name)::INT AS place FROM nation ORDER BY place LIMIT 12""")
def detected_first(t: Tables) -> DataFrame:
    """Those detected first, then by name, the first twelve."""
    order = [F.col("found").desc(), F.col("n_name")]
    top = t.nation.withColumn("found", F.col("n_nationkey") % 4 == 0).orderBy(*order).limit(12)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("n_name", "place")


@query("""SELECT conv_id, turn AS at, player FROM (SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS player FROM conversations) WHERE player = 1 OR player IS NULL""")
def player_positions(t: Tables) -> DataFrame:
    """Items of one player at their places in the whole list, and those of no player."""
    lists = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).alias("player")))).alias("all"))
    each = lists.select("conv_id", F.explode("all").alias("x")).select("conv_id", F.col("x.turn").alias("at"), F.col("x.player").alias("player"))
    return each.filter((F.col("player") == 1) | F.col("player").isNull())


@query("""SELECT term FROM (SELECT DISTINCT p_name AS term FROM part) ORDER BY term LIMIT 10""")
def capped_terms(t: Tables) -> DataFrame:
    """The cap on the terms of one request, which is the feature."""
    return t.part.select(F.col("p_name").alias("term")).distinct().orderBy("term").limit(10)


@query("""SELECT p_name AS alias_of, lower(p_name) AS alias FROM (SELECT DISTINCT p_name FROM part) UNION SELECT p_name, lower(p_name) || 's' FROM (SELECT DISTINCT p_name FROM part) WHERE p_name NOT LIKE '%s' AND length(p_name) > 5 UNION SELECT p_name, left(lower(p_name), length(p_name) - 1) FROM (SELECT DISTINCT p_name FROM part) WHERE p_name LIKE '%s' AND length(p_name) > 6""")
def alias_variants(t: Tables) -> DataFrame:
    return transcript.alias_variants(t.part.select("p_name").distinct(), "p_name").select(F.col("canonical").alias("alias_of"), "alias")


@query("""SELECT n_nationkey, 'general' AS plain, 'shooting_phase' AS phase_rule, 'command' AS phase, ['&', '<'] AS decoded, 65 * 60 + n_nationkey AS seconds FROM nation""")
def rule_scalars(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    amp = lambda s: tx.decode_entities(F.lit(s))
    return t.nation.select("n_nationkey", tx.rule_category(F.lit("lore of old")).alias("plain"), tx.rule_category(F.lit("In your Shooting phase, each unit")).alias("phase_rule"), tx.phase_of(F.lit("Your Command phase")).alias("phase"), F.array(amp("&amp;"), amp("&lt;")).alias("decoded"), tx.seconds_of(F.concat(F.lit("1:05:"), F.lpad(k.cast("string"), 2, "0"))).alias("seconds"))


@query("""SELECT DISTINCT p_name AS name, dice AS close FROM (SELECT p_name, true AS dice FROM part)""")
def is_match(t: Tables) -> DataFrame:
    """Every name is alike enough to itself with its last letter cut off, as Dice similarity of at least 0.7 has it."""
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    cut = names.select(F.expr("substring(name, 1, length(name) - 1)").alias("term"), F.col("name").alias("own"))
    close = match.similarity_join(cut.select("term"), names, "term", "name", 0.7)
    ok = cut.join(close, "term").filter("own = name").select("own").distinct().withColumn("close", F.lit(True))
    return names.join(ok, F.col("name") == F.col("own"), "left").select("name", F.coalesce("close", F.lit(False)).alias("close"))

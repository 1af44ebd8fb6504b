"""Queries of nested pages and catalogues, closures, phrase dictionaries, approximate search and ordered streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import slugify
from lorespark.operators import approx, closure, hashtree, match, phrases
from lorespark.plans import Tables, query
from lorespark.plans.text import _DICE
from lorespark.scratch import Scratch
from lorespark.sources import catalog, elements
from lorespark.streaming import ordered, sinks


@query("""SELECT page_id, regexp_replace(html, '<div class="ad">[^<]*</div>', '', 'g') AS html FROM pages""")
def pages_without_ads(t: Tables) -> DataFrame:
    return elements.without(t.pages.select("page_id", "html"), ["ad"])


@query("""SELECT page_id, count(*) FILTER (WHERE x LIKE '<p%' OR x LIKE '<P%') AS p_open, count(*) FILTER (WHERE lower(x) = '</p>') AS p_closed, count(*) FILTER (WHERE lower(x) LIKE '<a %') AS links
          FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '(?i)</?(?:p|a)(?:\\s[^>]*)?>')) AS x FROM pages) GROUP BY page_id""")
def page_tags(t: Tables) -> DataFrame:
    told = elements.tokens(t.pages)
    n = lambda cond, name: F.count_if(cond).alias(name)
    p, a = F.col("tag") == "p", F.col("tag") == "a"
    return told.groupBy("page_id").agg(n(p & (F.col("step") == 1), "p_open"), n(p & (F.col("step") == -1), "p_closed"), n(a & (F.col("step") == 1) & elements.attribute(F.col("token"), "href").isNotNull(), "links"))


def _tables(t: Tables) -> DataFrame:
    """A page per nation: a table whose second row holds a table of its suppliers, and a lore block with a block in it."""
    rows = t.supplier.groupBy(F.col("s_nationkey").alias("page_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(F.lit("<tr><td>"), "s_name", F.lit('</td><td class="x">a &amp; '), F.col("s_suppkey").cast("string"), F.lit("</td></tr>")).alias("r")))), lambda x: x["r"]), "").alias("inner")
    )
    html = F.concat(
        F.lit('<div class="ShowFluff big"><div>Long <b>ago</b></div><div class="y">and far</div> away</div><TABLE><tr><th>Name'), F.lit("</th><th>Staff</th></tr><tr><td>"), "n_name",
        F.lit("<script>var x = '<td>';</script></td><td>The <i>staff</i>:<table>"), F.coalesce("inner", F.lit("")), F.lit("</table> of them</td></tr></TABLE><p>End"),
    )
    return t.nation.withColumn("page_id", F.col("n_nationkey").cast("bigint")).join(rows, "page_id", "left").select("page_id", html.alias("html"))


@query("""SELECT n_nationkey::BIGINT AS page_id, false AS inside, row_no, cell_no, row_no = 0 AS is_head, txt AS text FROM nation, LATERAL (VALUES (0, 0, 'Name'), (0, 1, 'Staff'), (1, 0, n_name), (1, 1, 'The staff: of them')) v(row_no, cell_no, txt)
          UNION ALL SELECT s_nationkey, true, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT, 0, false, s_name FROM supplier
          UNION ALL SELECT s_nationkey, true, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT, 1, false, 'a & ' || s_suppkey FROM supplier""")
def nested_cells(t: Tables) -> DataFrame:
    return elements.cells(_tables(t)).select("page_id", F.col("outer_at").isNotNull().alias("inside"), "row_no", "cell_no", "is_head", "text")


@query("""SELECT n_nationkey::BIGINT AS page_id, 'NameStaff' || n_name || 'The staff:' || coalesce(string_agg(s_name || 'a & ' || s_suppkey, '' ORDER BY s_suppkey), '') || ' of themEnd' AS told FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name""")
def pages_without_lore(t: Tables) -> DataFrame:
    """A block and all that is nested in it go; the tables stay."""
    left = elements.without(_tables(t), ["ShowFluff"])
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b.*?</script>", ""), "<[^>]+>", "")
    return left.select("page_id", F.replace(bare, F.lit("&amp;"), F.lit("&")).alias("told"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 60 AS a, l_suppkey % 60 AS b FROM lineitem WHERE l_quantity < 3 AND l_partkey % 60 <> l_suppkey % 60),
          r AS (SELECT a AS start, a AS node, 0 AS steps FROM (SELECT DISTINCT a FROM e) UNION SELECT start, b, steps + 1 FROM r JOIN e ON node = a WHERE steps < 60)
          SELECT start, node, min(steps)::INT AS steps FROM r GROUP BY start, node""")
def reachable_keys(t: Tables) -> DataFrame:
    links = t.lineitem.filter("l_quantity < 3").select((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 60).alias("b")).filter("a <> b")
    return closure.reachable(links.select(F.col("a").alias("start")), links)


def _catalogues(t: Tables) -> DataFrame:
    """A catalogue per brand: a unit with a weapon for each of its sizes in a chain of nested entries, one in a group for each name, and a link to the unit's twin in the next brand, which links back."""
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    one = t.part.select(n.alias("n"), "p_name", "p_size")
    names = one.groupBy("n").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.array_sort(F.collect_set(F.col("p_size") % 7)).alias("sizes"))
    profile = lambda name, kind: F.concat(F.lit('<profile name="'), name, F.lit(f'" typeName="{kind}"><characteristics><characteristic name="Range">'), name, F.lit(' &quot;</characteristic><characteristic name="A"/></characteristics></profile>'))
    group = F.array_join(F.transform("names", lambda x: F.concat(F.lit('<selectionEntry type="upgrade"><profiles>'), profile(x, "Ranged Weapons"), profile(x, "Abilities"), F.lit("</profiles></selectionEntry>"))), "")
    size = lambda x: x.cast("string")
    chain = F.concat(F.array_join(F.transform("sizes", lambda x: F.concat(F.lit('<selectionEntries><selectionEntry type="model" id="x'), "key", F.lit("-"), size(x), F.lit('"><profiles>'), profile(F.concat(F.lit("blade "), size(x)), "Melee Weapons"), F.lit("</profiles>"))), ""), F.repeat(F.lit("</selectionEntry></selectionEntries>"), F.size("sizes")))
    unit = lambda i, hidden: F.concat(F.lit('<selectionEntry type="unit" id="u'), i, F.lit(f'" name="Unit {hidden} '), i, F.lit(f'" hidden="{hidden}"><entryLinks><entryLink targetId="g'), F.col("key"), F.lit('"/></entryLinks>'), chain, F.lit("</selectionEntry>"))
    shared = F.concat(F.lit('<sharedSelectionEntries><selectionEntry type="upgrade" id="g'), "key", F.lit('"><selectionEntryGroups><selectionEntryGroup><selectionEntries>'), group, F.lit('</selectionEntries></selectionEntryGroup></selectionEntryGroups><entryLinks><entryLink targetId="g'), "key", F.lit('"/></entryLinks></selectionEntry></sharedSelectionEntries>'))
    return names.withColumn("key", F.col("n").cast("string")).select(F.col("n").alias("catalogue"), F.concat(F.lit("<catalogue>"), unit(F.col("key"), "false"), unit(F.concat("key", F.lit("h")), "true"), shared, F.lit("</catalogue>")).alias("xml"))


@query("""WITH p AS (SELECT regexp_extract(p_brand, '(\\d+)', 1)::INT AS catalogue, p_name, p_size FROM part)
          SELECT catalogue, 'Unit false ' || catalogue AS unit, name, type_name, name || ' "' AS range FROM (
            SELECT DISTINCT catalogue, p_name AS name, 'Ranged Weapons' AS type_name FROM p UNION ALL SELECT DISTINCT catalogue, 'blade ' || p_size % 7, 'Melee Weapons' FROM p)""")
def entry_weapons(t: Tables) -> DataFrame:
    """Weapons that a unit holds in nested entries at any depth, in groups, and over links that lead back to themselves; hidden units are left out."""
    held = catalog.entry_profiles(_catalogues(t), ["Ranged Weapons", "Melee Weapons"])
    return held.select("catalogue", "unit", "name", "type_name", F.col("values")["Range"].alias("range"))


PHRASES = """SELECT DISTINCT lower(p) AS p FROM (SELECT unnest([split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3), split_part(text, ' ', 4), split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4)]) AS p FROM conversations WHERE turn = 0)
             WHERE regexp_full_match(p, '[A-Za-z][A-Za-z ]+[A-Za-z]')"""


def _dictionary(t: Tables) -> DataFrame:
    """Runs of words that open a conversation."""
    w = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    runs = t.conversations.filter("turn = 0").select(F.explode(F.array(F.concat_ws(" ", w(2), w(3)), w(4), F.concat_ws(" ", w(2), w(3), w(4)))).alias("p"))
    return runs.filter(F.col("p").rlike("^[A-Za-z][A-Za-z ]+[A-Za-z]$")).select(F.lower("p").alias("phrase")).distinct()


@query(f"""WITH d AS ({PHRASES}), a AS (SELECT '(?i)\\b(?:' || string_agg(regexp_escape(p), '|' ORDER BY length(p) DESC, p) || ')\\b' AS pattern FROM d)
           SELECT conv_id, turn, list_transform(regexp_extract_all(text, pattern), lambda x: lower(x)) AS hits FROM conversations, a""")
def phrase_hits(t: Tables) -> DataFrame:
    found = phrases.join_phrases(t.conversations.select("conv_id", "turn", "text"), _dictionary(t))
    return found.select("conv_id", "turn", F.transform("hits", lambda h: F.lower(F.substring(F.col("text"), h["start"] + 1, h["length"]))).alias("hits"))


@query()
def phrase_tags(t: Tables) -> DataFrame:
    """Each phrase as its initials, once as names and once in tags."""
    d = _dictionary(t).withColumns({"official": F.concat(F.lit("Q"), F.replace("phrase", F.lit(" "), F.lit("_"))), "kind": F.lit("term")})
    named = phrases.replace_phrases(t.conversations.select("conv_id", "turn", "text"), d)
    return phrases.replace_phrases(named, d, tag=True, out="tagged").select("conv_id", "turn", "replaced", "tagged")


@query("""WITH i AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS canonical FROM part),
          q AS (SELECT DISTINCT unnest([replace(name, 'l', ''), replace(name, 'e', 'a') || 's', upper(name), split_part(name, ' ', 2)]) AS term FROM i),
          f AS (SELECT name, unnest([lower(name), canonical]) AS txt, unnest([0.7, 0.3]) AS weight FROM i),
          m AS (SELECT term, txt, min(levenshtein(lower(term), substring(txt, s, n))) AS e FROM q, (SELECT DISTINCT txt FROM f), range(1, 40) r(s), range(0, 40) l(n) WHERE s + n <= length(txt) + 1 GROUP BY ALL),
          g AS (SELECT *, CASE WHEN lower(term) = txt THEN pow(2, -52) ELSE greatest(e / length(term), 0.001) END AS s FROM m
                WHERE e / length(term) <= 0.4 AND (lower(term) = txt OR regexp_matches(txt, '[' || lower(term) || ']{3}')))
          SELECT term, name, round(exp(sum(weight * round(1 / sqrt(length(txt) - length(replace(txt, ' ', '')) + 1), 3) * ln(s))), 6) AS score FROM g JOIN f USING (txt) GROUP BY term, name""")
def approximate_names(t: Tables) -> DataFrame:
    """Names found by misspelt, shouted and partial ones, in their own and in their canonical form."""
    items = t.part.select(F.col("p_name").alias("name")).distinct().withColumn("canonical", slugify(F.col("name")))
    n = F.col("name")
    terms = items.select(F.explode(F.array(F.replace(n, F.lit("l"), F.lit("")), F.concat(F.replace(n, F.lit("e"), F.lit("a")), F.lit("s")), F.upper(n), F.split_part(n, F.lit(" "), F.lit(2)))).alias("term"))
    return approx.approximate_search(terms, items, "term", {"name": 0.7, "canonical": 0.3}).select("term", "name", F.round("score", 6).alias("score"))


@query(_DICE.format(names="SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation", terms="SELECT replace(n_name, 'TION', 'TON') || 's' AS term FROM nation UNION SELECT 'x' || substr(p_name, 2) FROM part")
       + "SELECT term, name, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, name) AS rank FROM s WHERE score >= 0.3) WHERE rank <= 3")
def nearest_names(t: Tables) -> DataFrame:
    """The three names most alike to each misspelt one; most terms never see the lower bounds."""
    names = t.part.select(F.col("p_name").alias("name")).union(t.supplier.select("s_name")).union(t.nation.select("n_name"))
    terms = t.nation.select(F.concat(F.replace("n_name", F.lit("TION"), F.lit("TON")), F.lit("s")).alias("term")).union(t.part.select(F.concat(F.lit("x"), F.substring("p_name", 2, 1 << 30))))
    return match.top_similar(terms, names, "term", "name", 3, 0.3).withColumn("score", F.round("score", 9))


@query("""WITH b AS (SELECT DISTINCT l_suppkey % 20 AS grp, l_partkey AS member FROM lineitem WHERE l_quantity > 2), a AS (SELECT DISTINCT l_suppkey % 20 AS grp, l_partkey AS member FROM lineitem WHERE l_suppkey % 20 < 18 AND (l_quantity > 3 OR l_suppkey % 20 > 2))
          SELECT *, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def changed_members(t: Tables) -> DataFrame:
    """Parts of supplier groups that came and went: some groups lose a few or all, others gain a few."""
    rows = t.lineitem.select((F.col("l_suppkey") % 20).alias("grp"), F.col("l_partkey").alias("member"), "l_quantity")
    after = rows.filter("grp < 18 and (l_quantity > 3 or grp > 2)")
    return hashtree.changed_members(rows.filter("l_quantity > 2"), after, ["grp"], "member")


@query("""WITH m AS (SELECT (epoch_ms(max(ts)) - 7200000) * 1000 AS mark FROM events),
          l AS (SELECT user_id, list(CASE event_type WHEN 'purchase' THEN -2 WHEN 'signup' THEN 3 WHEN 'view' THEN 1 ELSE 0 END ORDER BY ts, CASE event_type WHEN 'purchase' THEN -2 WHEN 'signup' THEN 3 WHEN 'view' THEN 1 ELSE 0 END) AS d, max(ts) AS until FROM events, m WHERE epoch_us(ts) <= mark GROUP BY user_id)
          SELECT user_id, list_reduce(list_prepend(6, d), lambda a, x: greatest(0, least(12, a + x)))::BIGINT AS balance, len(d)::BIGINT AS n_events, until FROM l""")
def streamed_balances(t: Tables) -> DataFrame:
    """The events as a stream whose balances a table keeps: what the watermark, two hours behind, has passed."""
    d = F.when(F.col("event_type") == "purchase", -2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "view", 1).otherwise(0)
    path = Scratch(t.spark, "streamed").root
    rows = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/events.parquet*").select("user_id", F.col("ts").cast("timestamp").alias("ts"), d.alias("d"))
    folded = ordered.clamped_in_order(rows, "user_id", "ts", "d", 6, 0, 12, "2 hours")
    sink = sinks.table_sink(f"{path}/table", ["user_id"], sinks.upserted(["user_id"], [F.col("n_events").desc()]))
    folded.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return sinks.read(t.spark, f"{path}/table", "user_id bigint, balance bigint, n_events bigint, until timestamp").withColumn("until", F.col("until").cast("timestamp_ntz"))

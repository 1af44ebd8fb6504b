"""Queries over texts, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import phonetic, text
from lorespark.functions.similarity import dice
from lorespark.operators import match, merge, transcript
from lorespark.plans import Tables, query
from lorespark.sources import captions, pages

_DICE = """WITH n AS (SELECT DISTINCT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS b FROM ({names})),
g AS (SELECT name, b, list_distinct(list_transform(range(1, greatest(length(b), 2)), lambda i: b[i:i + 1])) AS g FROM n),
q AS (SELECT DISTINCT term, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS b FROM ({terms})),
h AS (SELECT term, b, list_distinct(list_transform(range(1, greatest(length(b), 2)), lambda i: b[i:i + 1])) AS g FROM q),
s AS (SELECT term, name, CASE WHEN h.b = g.b THEN 1.0 WHEN h.b = '' OR g.b = '' THEN 0.0
        WHEN contains(h.b, g.b) OR contains(g.b, h.b) THEN least(length(h.b), length(g.b)) / greatest(length(h.b), length(g.b))::DOUBLE
        ELSE 2.0 * len(list_intersect(h.g, g.g)) / (len(h.g) + len(g.g)) END::DOUBLE AS score FROM h, g)
"""


def readable_sql(html: str) -> str:
    """text.readable() in DuckDB's words."""
    steps = [(r"(?i)</?h[1-6][^>]*>|</?p(?:\s[^>]*)?>|<table[^>]*>|<div[^>]*class=\"[^\"]*BreakInside[^\"]*\"[^>]*>", "\n\n"), (r"(?i)<br\s*/?>|</table>|</tr>", "\n"), (r"(?i)<li[^>]*>", "\n• "), (r"<[^>]+>", "")]
    for pattern, to in steps:
        html = f"regexp_replace({html}, '{pattern}', '{to}', 'g')"
    for name, to in text.ENTITIES.items():
        html = "replace({}, '{}', '{}')".format(html, name, to.replace("'", "''"))
    html = f"regexp_replace(regexp_replace({html}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', '\n\n', 'g')"
    return f"regexp_replace(array_to_string(list_transform(string_split({html}, '\n'), lambda x: trim(x)), '\n'), '^\\s+|\\s+$', '', 'g')"


_PARTS = "SELECT p_name AS name FROM part"
_TYPOS = "SELECT 'x' || substr(p_name, 2) AS term FROM part"


@query(_DICE.format(names=_PARTS, terms=_TYPOS) + "SELECT term, name, score FROM s WHERE score >= 0.6")
def similarity_join(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    terms = names.select(F.concat(F.lit("x"), F.substring("name", 2, 1 << 30)).alias("term"))
    return match.similarity_join(terms, names, "term", "name", 0.6)


_FUZZY = _DICE.format(names="SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation", terms="SELECT unnest(['natoin 12', 'suplier 12', 'smal ring', 'red wigdet', 'region']) AS term")


@query(_FUZZY + "SELECT term, name, floor(score * 100 + 0.5) / 100 AS confidence, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, name) AS rank FROM s WHERE score >= 0.3) WHERE rank <= 5")
def fuzzy_search(t: Tables) -> DataFrame:
    """The flagship: five terms against three categories of names, best five each."""
    names = t.part.select(F.col("p_name").alias("name")).union(t.supplier.select("s_name")).union(t.nation.select("n_name"))
    terms = t.spark.createDataFrame([(x,) for x in ("natoin 12", "suplier 12", "smal ring", "red wigdet", "region")], "term string")
    best = match.top_matches(match.similarity_join(terms, names, "term", "name", 0.3), "term", "name", 5)
    return best.select("term", "name", text.round2(F.col("score")).alias("confidence"), "rank")


@query()
def match_chain(t: Tables) -> DataFrame:
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    terms = names.select(F.explode(F.array("name", F.upper("name"), F.concat("name", F.lit("s")), F.regexp_replace("name", "c", "k"))).alias("term"))
    aliases = names.select(F.lower(F.split_part("name", F.lit(" "), F.lit(1))).alias("alias"), F.col("name").alias("canonical")).groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return match.match_chain(terms, names, aliases)


@query("""WITH d AS (SELECT lower(n_name) AS term, n_name AS canonical FROM nation), w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM conversations),
          g AS (SELECT conv_id, turn, i, n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
          v AS (SELECT word AS term, 'W' || word AS canonical FROM (VALUES ('the'), ('with'), ('of the'), ('et'), ('les')) x(word))
          SELECT conv_id, turn, i::INT AS at, n::INT AS n, g.term, canonical FROM g JOIN v ON g.term = v.term""".replace("\\\\", "\\"))
def detect_mentions(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([(w, "W" + w, "word") for w in ("the", "with", "of the", "et", "les")], "term string, canonical string, kind string")
    segments = t.conversations.select("conv_id", "turn", "text")
    return match.detect_mentions(segments, F.broadcast(words), ["conv_id", "turn"]).select("conv_id", "turn", "at", "n", "term", "canonical")


@query("""WITH w AS (SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM conversations),
          g AS (SELECT conv_id, turn, i::INT AS i, n::INT AS n, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(w)),
          l AS (SELECT conv_id, turn, list({'at': i, 'n': n, 'term': g.term} ORDER BY i, n DESC) AS l FROM g WHERE g.term IN ('the', 'with', 'of the', 'et', 'les') GROUP BY ALL),
          f AS (SELECT conv_id, turn, unnest(list_reduce(l, lambda a, x: CASE WHEN x.at >= a.until THEN {'until': x.at + x.n, 'kept': list_append(a.kept, x)} ELSE a END,
                       {'until': 0::INT, 'kept': []::STRUCT("at" INT, n INT, term VARCHAR)[]}).kept) AS m FROM l)
          SELECT conv_id, turn, m.at AS "at", m.n AS n, m.term AS term, 'W' || m.term AS canonical, 'word' AS kind FROM f""".replace("\\\\", "\\"))
def mentions_longest_first(t: Tables) -> DataFrame:
    words = t.spark.createDataFrame([(w, "W" + w, "word") for w in ("the", "with", "of the", "et", "les")], "term string, canonical string, kind string")
    found = match.detect_mentions(t.conversations.select("conv_id", "turn", "text"), F.broadcast(words), ["conv_id", "turn"])
    return match.longest_first(found, ["conv_id", "turn"])


@query("""SELECT role, canonical, list_sort(list(DISTINCT turn * 7)) AS seconds, count(DISTINCT turn)::INT AS n, min(turn * 7) AS first_second FROM (SELECT role, lang AS canonical, turn FROM (SELECT role, turn, CASE WHEN contains(lower(text), ' the ') THEN 'en' ELSE 'other' END AS lang FROM conversations)) GROUP BY ALL""")
def mention_index(t: Tables) -> DataFrame:
    rows = t.conversations.select("role", F.when(F.contains(F.lower("text"), F.lit(" the ")), "en").otherwise("other").alias("canonical"), (F.col("turn") * 7).alias("ts"))
    return transcript.mention_index(rows, "role", "canonical", "ts")


@query("""SELECT doc_id, "at", line FROM (SELECT *, lag(trim(line)) OVER (PARTITION BY doc_id ORDER BY "at") AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS "at" FROM documents)) WHERE b IS NULL OR b <> trim(line)""")
def drop_repeated_lines(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return transcript.drop_repeats(lines, ["doc_id"], ["at"], "line").select("doc_id", F.col("at").cast("bigint").alias("at"), "line")


@query("""SELECT doc_id, md5(text) AS text_md5, sha256(text) AS text_sha256, length(text)::BIGINT AS n, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS norm,
                 regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents""".replace("\\\\", "\\"))
def text_scalars(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.md5("text").alias("text_md5"), F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n"), text.normalize_string(c).alias("norm"), text.slugify(c).alias("slug"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'econ') THEN 'metal' WHEN contains(lower(p_type), 'small') OR contains(lower(p_type), 'large') THEN 'alloy' ELSE 'other' END AS category FROM part""")
def keyword_cascade(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.cascade(F.col("p_type"), {"metal": ("econ",), "alloy": ("small", "large")}, "other").alias("category"))


@query("""SELECT c_custkey, coalesce(nullif(regexp_extract(c_name, '(\\d+)', 1), ''), '1') AS cost, nullif(try_cast(regexp_extract(c_name, '(\\d+)$', 1) AS INT), 0) AS num FROM customer""".replace("\\\\", "\\"))
def number_extraction(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.first_number(F.col("c_name"), r"(\d+)", "1").alias("cost"), text.parse_int(F.regexp_extract("c_name", r"(\d+)$", 1)).alias("num"))


@query("""SELECT event_id, event_id * 7 AS seconds, event_id * 7 AS back FROM events""")
def clock_round_trip(t: Tables) -> DataFrame:
    shown = t.events.select("event_id", (F.col("event_id") * 7).alias("seconds"))
    return shown.select("event_id", "seconds", text.seconds_of(text.clock(F.col("seconds"))).alias("back"))


@query("""SELECT page_id, url, md5(url) AS url_hash, sha256(html) AS content_hash, CASE WHEN contains(url, '/datasheets') THEN 'datasheet' WHEN contains(url, '/factions/') THEN 'faction' WHEN contains(url, '?') THEN 'query' ELSE 'page' END AS kind FROM pages""")
def page_cache(t: Tables) -> DataFrame:
    return pages.cached(t.pages)


@query(f"SELECT page_id, {readable_sql('html')} AS text FROM pages")
def page_text(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.readable(F.col("html")).alias("text"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract_all(html, '\\]\\(([^)\\s]+)\\)', 1) || regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages),
          u AS (SELECT page_id, site, unnest(l) AS href, unnest(range(0, len(l))) AS i FROM h), f AS (SELECT page_id, site, href, min(i) AS i FROM u GROUP BY ALL)
          SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS "at", CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN site || href ELSE site || '/' || href END AS target FROM f""")
def page_links(t: Tables) -> DataFrame:
    return pages.page_links(t.pages)


@query(f"""WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(html, '(?i)(<h[1-6][ >])', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)^<h[1-6][ >]')) AS parts FROM pages),
          e AS (SELECT page_id, unnest(parts) AS part, unnest(range(0, len(parts)))::INT AS "at" FROM p)
          SELECT page_id, "at", regexp_extract(part, '(?is)^<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS level,
                 trim(regexp_replace(replace(regexp_replace(regexp_extract(part, '(?is)^<h([1-6])[^>]*>(.*?)</h[1-6]>', 2), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS title,
                 {readable_sql("regexp_replace(part, '(?is)^<h([1-6])[^>]*>(.*?)</h[1-6]>', '', 'g')")} AS body FROM e""")
def page_sections(t: Tables) -> DataFrame:
    return pages.headed_sections(t.pages)


@query()
def sound_codes(t: Tables) -> DataFrame:
    """The four codes of every name of three categories."""
    names = t.nation.select(F.col("n_name").alias("name")).union(t.region.select("r_name")).union(t.part.select("p_name").distinct())
    return names.select("name", phonetic.codes(F.col("name")).alias("c")).select("name", "c.*")


@query("""WITH k AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS q FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
          n AS (SELECT DISTINCT unnest(q) AS qw FROM k), v AS (SELECT DISTINCT unnest(w) AS dw FROM d), m AS (SELECT qw, dw FROM n JOIN v ON contains(dw, qw)),
          h AS (SELECT DISTINCT doc_id, qw FROM (SELECT doc_id, unnest(w) AS dw FROM d) e JOIN m ON e.dw = m.dw)
          SELECT item_id, doc_id FROM (SELECT item_id, len(q) AS n, unnest(q) AS qw FROM k) i JOIN h ON i.qw = h.qw GROUP BY ALL HAVING count(*) = max(n)""")
def word_containment(t: Tables) -> DataFrame:
    """Every word of the item is part of a word of the text. Items meet texts by the word that fewest texts have; only such pairs are compared word by word."""
    words = lambda df, key: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)).alias("w"))
    return match.word_parts(words(t.benchmark, "item_id"), words(t.documents, "doc_id"), "item_id", "doc_id", "w")


@query("""SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name AND split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)""")
def block_pairs(t: Tables) -> DataFrame:
    n = t.part.select("p_name").distinct().withColumn("k", F.split_part("p_name", F.lit(" "), F.lit(2)))
    b = n.select(F.col("p_name").alias("b"), F.col("k").alias("k2"))
    return n.join(b, (F.col("k") == F.col("k2")) & (F.col("p_name") < F.col("b"))).select(F.col("p_name").alias("a"), "b")


@query("""WITH l AS (SELECT conv_id, turn, turn * 0.25 AS start, trim(replace(replace(replace(replace(replace(regexp_replace(split_part(role, 't', 1), '<[^>]+>', '', 'g'), '&amp;', '&'), '&#39;', chr(39)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS text FROM conversations),
          o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, floor(start), text ORDER BY turn) AS n FROM l WHERE text <> ''),
          c AS (SELECT conv_id, list({'start': start::DOUBLE, 'duration': 0.5::DOUBLE, 'text': text} ORDER BY turn) AS l FROM o WHERE n = 1 GROUP BY conv_id),
          f AS (SELECT conv_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(a) > 0 AND a[-1].text = x.text AND x.start - a[-1].start < 0.5
                       THEN list_append(a[:-2], {'start': a[-1].start, 'duration': x.start + x.duration - a[-1].start, 'text': x.text}) ELSE list_append(a, x) END,
                       []::STRUCT("start" DOUBLE, duration DOUBLE, "text" VARCHAR)[])) AS s FROM c)
          SELECT conv_id, s.start AS start, s.duration AS duration, s.text AS text FROM f""")
def captions_parse(t: Tables) -> DataFrame:
    """Roles of conversations written as caption files of four lines a second, and parsed back."""
    at = F.col("turn") * 250
    stamp = lambda ms: F.format_string("00:%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)
    line = F.concat(stamp(at), F.lit(" --> "), stamp(at + 500), F.lit("\n"), F.split_part("role", F.lit("t"), F.lit(1)), F.lit("\n"))
    files = t.conversations.groupBy("conv_id").agg(F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")).alias("vtt"))
    return captions.parse(files, "conv_id", "vtt")


@query("""WITH s AS (SELECT conv_id, turn, length(text) AS len FROM conversations) SELECT conv_id, turn, len::BIGINT AS len FROM (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM s) WHERE c <= 500""")
def budget_prefix(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").cast("bigint").alias("len"))
    return transcript.within_budget(rows, ["conv_id"], ["turn"], "len", 500)


@query(_DICE.format(names="SELECT r_name AS name FROM region", terms="SELECT n_name AS term FROM nation") + "SELECT term AS n_name, name AS r_name, floor(score * 100 + 0.5) / 100 AS score FROM s JOIN nation ON term = n_name JOIN region ON n_regionkey = r_regionkey AND r_name = name")
def dice_scores(t: Tables) -> DataFrame:
    n = t.nation
    return n.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", text.round2(dice(F.col("n_name"), F.col("r_name"))).alias("score"))


@query("""SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS users, count(*) FILTER (WHERE role = 'assistant') AS assistants, max(length(text))::INT AS longest FROM conversations GROUP BY conv_id""")
def role_histogram(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"), F.max(F.length("text")).alias("longest"))


@query("""SELECT d.doc_id, coalesce(quality, 0) AS quality, CASE WHEN toxic = 1 THEN 'low' WHEN quality = 1 THEN 'high' ELSE 'medium' END AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def labelled_with_defaults(t: Tables) -> DataFrame:
    c = F.when(F.col("toxic") == 1, "low").when(F.col("quality") == 1, "high").otherwise("medium")
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), c.alias("confidence"))


@query("""WITH d AS (SELECT lower(n_name) AS k, n_name AS name, 'nation' AS kind, 1 AS p FROM nation UNION ALL SELECT lower(r_name), r_name, 'region', 0 FROM region UNION ALL SELECT DISTINCT lower(p_type), p_type, 'type', 2 FROM part),
          t AS (SELECT upper(n_name) AS term FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT p_type FROM part UNION SELECT p_brand FROM part)
          SELECT term, coalesce(arg_min(kind, (p, name)), 'unknown') AS kind, arg_min(name, (p, name)) AS canonical FROM t LEFT JOIN d ON lower(term) = k GROUP BY term""")
def categorize_terms(t: Tables) -> DataFrame:
    entry = lambda df, c, kind, p: df.select(F.col(c).alias("name"), F.lit(kind).alias("kind"), F.lit(p).alias("precedence")).distinct()
    entries = entry(t.nation, "n_name", "nation", 1).union(entry(t.region, "r_name", "region", 0)).union(entry(t.part, "p_type", "type", 2))
    terms = t.nation.select(F.upper("n_name").alias("term")).union(t.region.select(F.lower("r_name"))).union(t.part.select("p_type")).union(t.part.select("p_brand"))
    return merge.categorize(terms, entries)


@query("""WITH m AS (SELECT DISTINCT p_brand, CASE WHEN p_size > 25 THEN p_type END AS scope, max(p_name) AS v FROM part GROUP BY ALL), q AS (SELECT DISTINCT p_brand, p_type AS scope FROM part)
          SELECT q.p_brand, q.scope, coalesce(o.v, g.v) AS v FROM q LEFT JOIN m o ON q.p_brand = o.p_brand AND q.scope = o.scope LEFT JOIN m g ON q.p_brand = g.p_brand AND g.scope IS NULL""")
def scoped_mapping(t: Tables) -> DataFrame:
    m = t.part.groupBy("p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("scope")).agg(F.max("p_name").alias("v"))
    return merge.scoped_mapping(t.part.select("p_brand", F.col("p_type").alias("scope")), m, ["p_brand"], "scope", "v")


@query("""SELECT report, chunk, name, player, confidence FROM (
            SELECT conv_id AS report, turn AS chunk, role AS name, turn % 2 AS player, CASE turn % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS confidence,
                   row_number() OVER (PARTITION BY conv_id, lower(role), turn % 2 ORDER BY CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END DESC, turn) AS n FROM conversations) WHERE n = 1""")
def merge_chunks(t: Tables) -> DataFrame:
    level = F.expr("case turn % 3 when 0 then 'low' when 1 then 'high' else 'medium' end")
    rows = t.conversations.select(F.col("conv_id").alias("report"), F.col("turn").alias("chunk"), F.col("role").alias("name"), (F.col("turn") % 2).alias("player"), level.alias("confidence"))
    return merge.merge_units(rows)


@query("""SELECT conv_id, arg_min(CASE WHEN role = 'system' THEN text END, turn) FILTER (WHERE role = 'system') AS system_text, arg_min(text, turn) FILTER (WHERE role = 'user') AS user_text FROM conversations GROUP BY conv_id""")
def first_scalars(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "system", F.col("text")).alias("system_text"), F.when(F.col("role") == "user", F.col("text")).alias("user_text"))
    return merge.merge_scalars(rows, "conv_id", "turn", ["system_text", "user_text"])


@query()
def tagged_conversations(t: Tables) -> DataFrame:
    """Conversations with two words normalised and tagged."""
    words = [("the", "Thee", "article"), ("with", "Withal", "prep")]
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("original"), F.lit(n).alias("official"), F.lit(k).alias("type")) for o, n, k in words])).alias("w")
    rep = t.conversations.select("conv_id").distinct().select("conv_id", each).select("conv_id", "w.*")
    return transcript.tag_text(transcript.normalize_text(t.conversations.select("conv_id", "turn", "text"), rep, "conv_id").drop("text").withColumnRenamed("normalized", "text"), rep, "conv_id")

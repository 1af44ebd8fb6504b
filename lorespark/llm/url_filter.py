"""URL filters by temporal list joins.

A list is a log of dated entries: from a day on, a pattern is blocked, allowed,
or taken off the list. Each pattern's entries become validity intervals, and
every capture is judged by the entries that were active when it was fetched:
an as-of join on each pattern that could cover its URL. A pattern is a host, a
parent domain of hosts, or a host with a path prefix of whole segments; the
most specific active one decides, a block before an allow of equal reach.

Patterns meet by hashes that a fold over labels and segments makes, one step
for each, so a URL with very many of them costs no more than its length; what
meets is then compared as text. Intervals stay rows: those of a pattern with
many of them are cut into days, so that a capture meets those of its day only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, attach

ENTRIES = "list_name string, pattern string, action string, since timestamp"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty where the URL has none."""
    return F.rtrim(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


#: A pattern with more intervals than this is cut into days.
MANY = 64


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, since, until, action, list_name: the validity intervals of every pattern.

    Within a list an entry holds until the next one of the same pattern; of
    entries of one moment, a removal comes first, then allow, then block, and
    the last holds. Entries with a null pattern, action or date are left out.
    """
    order = F.expr("case action when 'remove' then 0 when 'allow' then 1 else 2 end")
    log = Window.partitionBy("list_name", "pattern").orderBy("since", order)
    held = entries.filter("pattern is not null and since is not null and action in ('block', 'allow', 'remove')").withColumn("until", F.lead("since").over(log))
    return held.filter("action <> 'remove' and (until is null or until > since)").select("pattern", "since", "until", "action", "list_name")


def _hashed(parts: Column, first: Column) -> Column:
    """Hash of all parts, each folded into that of the parts before."""
    return F.aggregate(parts, first, lambda h, x: F.xxhash64(h, x))


def _folded(parts: Column, first: Column) -> Column:
    """Hashes of the first 1, 2, ... of a few parts, as _hashed() makes them."""
    all_ = F.aggregate(parts, F.array(first), lambda hs, x: F.concat(hs, F.array(F.xxhash64(F.element_at(hs, -1), x))))
    return F.slice(all_, F.lit(2), F.size(parts))


def _labels(host: Column) -> Column:
    """Labels of a host from the right."""
    return F.reverse(F.split(host, r"\."))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


#: What the hashes of domains and of paths begin with.
DOMAIN, PATH = 1, 2


def _start() -> Column:
    return F.lit(DOMAIN).cast("bigint")


def _pattern_key(pattern: Column) -> Column:
    host, path = F.split_part(pattern, F.lit("/"), F.lit(1)), F.regexp_extract(pattern, r"^[^/]*(/.*)$", 1)
    domain = _hashed(_labels(host), _start())
    segments = _segments(path)
    return F.when(F.size(segments) == 0, domain).otherwise(_hashed(segments, F.xxhash64(F.lit(PATH), domain)))


def _probes(host: Column, path: Column, labels: Column, segments: Column) -> Column:
    """(labels, segments, key) of each pattern of at most so many labels and segments that covers a URL; labels, then segments, tell its reach."""
    shape = "array<struct<labels:int,segments:int,key:bigint>>"
    all_labels, some_segments = _labels(host), F.slice(_segments(path), F.lit(1), segments)
    # As many labels and segments as a pattern has at most; the exact host takes all of its labels.
    domains = F.transform(_folded(F.slice(all_labels, F.lit(1), labels), _start()), lambda h, i: F.struct((i + 1).alias("labels"), F.lit(0).alias("segments"), h.alias("key")))
    paths = F.transform(_folded(some_segments, F.xxhash64(F.lit(PATH), _hashed(all_labels, _start()))), lambda h, i: F.struct(F.size(all_labels).alias("labels"), (i + 1).alias("segments"), h.alias("key")))
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast(shape)).otherwise(F.concat(domains, F.when(F.size(all_labels) <= labels, paths).otherwise(F.array())).cast(shape))


def _pattern_text(host: Column, path: Column, labels: Column, segments: Column) -> Column:
    """The pattern of a probe as text."""
    parts = F.split(host, r"\.")
    domain = F.array_join(F.slice(parts, F.size(parts) - labels + 1, labels), ".")
    return F.when(segments == 0, domain).otherwise(F.concat(host, F.lit("/"), F.array_join(F.slice(_segments(path), F.lit(1), segments), "/")))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: page_id, url, fetched, verdict, the pattern and list that decided, kept.

    captures: page_id, url, fetched (timestamp); other columns are left out,
    whatever their names. verdict is block, allow or none (no active entry;
    URLs without a host, null URLs and captures without a time too). kept is
    false for block. Repeated captures come out as often as they came in;
    null page_ids stay null; URLs of any length are read whole. Empty captures
    give an empty result, an empty list the verdict none.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    spans = scratch.write(intervals(entries).withColumn("key", _pattern_key(F.col("pattern"))), "spans")
    many = spans.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("key")
    hosts = F.split_part("pattern", F.lit("/"), F.lit(1))
    longest = spans.agg(F.max(F.size(F.split(hosts, r"\."))), F.max(F.size(_segments(F.regexp_extract("pattern", r"^[^/]*(/.*)$", 1))))).first()
    rows = captures.select("page_id", "url", "fetched", F.monotonically_increasing_id().alias("row")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    probes = rows.withColumn("p", F.explode_outer(_probes(F.col("host"), F.col("path"), F.lit(longest[0] or 0), F.lit(longest[1] or 0)))).select("*", "p.*").drop("p")
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    if many.isEmpty():
        dated = spans.withColumn("day", F.lit(-1))
        probes = probes.withColumn("day", F.lit(-1))
    else:
        first, last = captures.agg(F.min(day(F.col("fetched"))), F.max(day(F.col("fetched")))).first()
        lo, hi = F.greatest(day(F.col("since")), F.lit(first or 0)), F.least(F.coalesce(day(F.col("until")), F.lit(last or 0)), F.lit(last or 0))
        whole = spans.join(many, "key", "left_anti").withColumn("day", F.lit(-1))
        dated = whole.unionByName(spans.join(many, "key", "left_semi").filter(lo <= hi).withColumn("day", F.explode(F.sequence(lo, hi))))
        probes = probes.withColumn("day", F.explode(F.array(F.lit(-1), F.coalesce(day(F.col("fetched")), F.lit(-2)))))
    met = attach(probes, dated, ["key", "day"], "row")
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    meant = F.col("pattern") == _pattern_text(F.col("host"), F.col("path"), F.col("labels"), F.col("segments"))
    best = F.max(F.when(active & meant, F.struct("labels", "segments", (F.col("action") == "block").alias("block"), "list_name", "pattern")))
    judged = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "fetched")], best.alias("b"))
    verdict = F.when(F.col("b").isNull(), "none").when(F.col("b.block"), "block").otherwise("allow")
    return judged.select("page_id", "url", "fetched", verdict.alias("verdict"), F.col("b.pattern").alias("pattern"), F.col("b.list_name").alias("list_name"), (verdict != "block").alias("kept"))


def captures_of(pages: DataFrame) -> DataFrame:
    """pages as captures: the tables hold no fetch time, so one in 2024 follows from page_id."""
    day = F.pmod(F.pmod(F.col("page_id"), F.lit(366)) * 37, F.lit(366)).cast("int")
    at = F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(day, F.lit(0), F.lit(0), F.pmod(F.col("page_id"), F.lit(86400)))
    return pages.select("page_id", "url", at.alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts that occur, by a rule on the md5 of the host; about half of them are listed at some time."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().withColumn("h", F.md5("host"))
    digit = lambda i, n=1: F.conv(F.substring("h", i, n), 16, 10).cast("int")
    day = lambda d: F.expr("timestamp'2024-01-01 00:00:00'") + F.make_dt_interval(d)
    first = digit(2, 2) % 180
    row = lambda name, pattern, action, d: F.struct(F.lit(name).alias("list_name"), pattern.alias("pattern"), F.lit(action).alias("action"), day(d).alias("since"))
    blocked = F.array(row("hosts", F.col("host"), "block", first), row("hosts", F.col("host"), "remove", first + 60 + digit(4, 2) % 60))
    paths = F.array(row("paths", F.concat("host", F.lit("/en")), "block", first), row("hosts", F.col("host"), "allow", first))
    domain = F.array(row("domains", F.array_join(F.slice(F.split("host", r"\."), -2, 2), "."), "block", F.lit(270)))
    chosen = F.when(digit(1) < 6, blocked).when(digit(1) < 10, paths).when(digit(1) == 15, domain)
    return hosts.filter(F.size(F.split("host", r"\.")) > 1).select(F.explode(chosen).alias("e")).select("e.*").distinct()


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(captures_of(pages), entries_of(pages))


OP1_SQL = r"""
WITH u AS (
  SELECT row_number() OVER () AS row, page_id, url, timestamp '2024-01-01' + to_days(((page_id % 366 * 37) % 366)::INT) + to_seconds(page_id % 86400) AS fetched,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)), '.') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segs
  FROM pages),
hosts AS (
  SELECT DISTINCT host, md5(host) AS h, ('0x' || md5(host)[1:1])::INT AS d, ('0x' || md5(host)[2:3])::INT % 180 AS f,
         ('0x' || md5(host)[4:5])::INT % 60 AS g, string_split(host, '.') AS l
  FROM u WHERE host <> '' AND contains(host, '.')),
e AS (
  SELECT 'hosts' AS list_name, host AS pattern, 'block' AS action, f AS day FROM hosts WHERE d < 6
  UNION ALL SELECT 'hosts', host, 'remove', f + 60 + g FROM hosts WHERE d < 6
  UNION ALL SELECT 'paths', host || '/en', 'block', f FROM hosts WHERE d BETWEEN 6 AND 9
  UNION ALL SELECT 'hosts', host, 'allow', f FROM hosts WHERE d BETWEEN 6 AND 9
  UNION ALL SELECT DISTINCT 'domains', l[-2] || '.' || l[-1], 'block', 270 FROM hosts WHERE d = 15),
t AS (
  SELECT *, timestamp '2024-01-01' + to_days(day) AS since,
         lead(timestamp '2024-01-01' + to_days(day)) OVER (PARTITION BY list_name, pattern ORDER BY day, CASE action WHEN 'remove' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS until
  FROM e),
p AS (
  SELECT row, n AS labels, 0 AS segments, array_to_string(string_split(host, '.')[-n:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM u WHERE host <> '')
  UNION ALL
  SELECT row, len(string_split(host, '.')), n, host || '/' || array_to_string(segs[1:n], '/')
  FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS n FROM u WHERE host <> '')),
hit AS (
  SELECT p.row, p.pattern, t.list_name, t.action,
         row_number() OVER (PARTITION BY p.row ORDER BY labels DESC, segments DESC, action = 'block' DESC, t.list_name DESC) AS n
  FROM p JOIN u ON p.row = u.row JOIN t ON p.pattern = t.pattern AND t.action <> 'remove' AND t.since <= u.fetched AND (t.until IS NULL OR u.fetched < t.until))
SELECT u.page_id, u.url, u.fetched, coalesce(hit.action, 'none') AS verdict, hit.pattern, hit.list_name, coalesce(hit.action, 'none') <> 'block' AS kept
FROM u LEFT JOIN hit ON u.row = hit.row AND hit.n = 1
"""

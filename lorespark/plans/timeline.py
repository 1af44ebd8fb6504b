"""Queries over time: as-of and band joins, folds, sections, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import joins, transcript
from lorespark.plans import Tables, query
from lorespark.streaming import events as ev

KINDS = ["view", "signup", "error", "click", "purchase"]


@query("""SELECT c.event_id, c.user_id, c.ts, v.ts AS ts_then, v.event_id AS seen_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def as_of_join(t: Tables) -> DataFrame:
    e = t.events
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"))
    return joins.as_of(clicks, views, "user_id", "ts", ["seen_id"])


@query("""SELECT c.event_id, v.ts AS ts_then, v.event_id AS seen_id FROM (SELECT *, user_id % 3 AS k FROM events WHERE event_type = 'error') c ASOF LEFT JOIN (SELECT *, user_id % 3 AS k FROM events WHERE event_type = 'purchase') v ON c.k = v.k AND c.ts >= v.ts""")
def as_of_hot_key(t: Tables) -> DataFrame:
    """Three keys hold all events: their streams are parted by day."""
    e = t.events.withColumn("k", F.col("user_id") % 3)
    left = e.filter("event_type = 'error'").select("event_id", "k", "ts")
    right = e.filter("event_type = 'purchase'").select("k", "ts", F.col("event_id").alias("seen_id"))
    return joins.as_of(left, right, "k", "ts", ["seen_id"], bucket=lambda c: F.to_date(c)).select("event_id", "ts_then", "seen_id")


@query("""SELECT a.event_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000""")
def band_join(t: Tables) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    a, b = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return joins.band(a, b, "user_id", "ts", 3600).select("event_id", "r_event_id")


@query("""SELECT event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'refund', 0""")
def counts_by_type(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([(k,) for k in [*KINDS, "refund"]], "event_type string")
    return ev.counts_by_type(t.events, kinds, "event_type")


@query("""WITH d AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN -2 WHEN 'signup' THEN 3 WHEN 'view' THEN 1 ELSE 0 END AS d FROM events)
          SELECT user_id, list_reduce(list_prepend(6, list(d ORDER BY ts, d)), lambda a, x: greatest(0, least(12, a + x)))::BIGINT AS balance, count(*)::INT AS n_events FROM d GROUP BY user_id""")
def clamped_fold(t: Tables) -> DataFrame:
    d = F.when(F.col("event_type") == "purchase", -2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "view", 1).otherwise(0)
    return ev.clamped(t.events.select("user_id", "ts", d.alias("d")), "user_id", "ts", "d", 6, 0, 12)


@query("""SELECT user_id, """ + ", ".join(f"bool_or(event_type = '{k}') AS has_{k}" for k in KINDS) + """, arg_max(event_type, (ts, event_type)) AS last_type, max(ts) AS last_ts FROM events GROUP BY user_id""")
def status_fold(t: Tables) -> DataFrame:
    return ev.status(t.events, "user_id", "ts", "event_type", KINDS)


@query("""SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS purchases FROM events""")
def running_total(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", "user_id", F.sum((F.col("event_type") == "purchase").cast("bigint")).over(w).alias("purchases"))


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def windowed_counts(t: Tables) -> DataFrame:
    return ev.windowed(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH o AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 86400000000 THEN 1 ELSE 0 END AS o FROM events)
          SELECT event_id, user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM o""")
def gap_sessions(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"))
    return transcript.gap_groups(rows, ["user_id"], "s", 86400.0, ["s", "event_id"]).select("event_id", "user_id", "session")


@query("""SELECT event_id, (props::JSON->>'k')::INT AS k FROM events WHERE (props::JSON->>'k')::INT > 50""")
def json_payload(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")).filter("k > 50")


@query("""SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, floor(turn * 0.7) ORDER BY turn) AS n FROM conversations) WHERE n = 1""")
def first_per_second(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("start", F.col("turn") * F.lit(0.7))
    return transcript.first_per_second(rows, ["conv_id"], "start", ["turn"]).select("conv_id", "turn", "text")


@query("""WITH r AS (SELECT conv_id, list({'start': turn * 40.0::DOUBLE, 'text': text, 'o': contains(lower(text), 'the') OR contains(lower(text), 'les'), 'c': contains(lower(text), 'deploy') OR contains(lower(text), 'first turn')} ORDER BY turn, text) AS l FROM conversations GROUP BY conv_id),
          f AS (SELECT conv_id, unnest(list_reduce(l, lambda a, x: {
                  'open': (a.open OR x.o) AND NOT (x.start > (CASE WHEN x.o AND NOT a.open THEN x.start + 120 ELSE a.until END) OR x.c),
                  'until': CASE WHEN x.o AND NOT a.open THEN x.start + 120 ELSE a.until END,
                  'kept': CASE WHEN a.open OR x.o THEN list_append(a.kept, {'start': x.start, 'text': x.text}) ELSE a.kept END},
                {'open': false, 'until': 0::DOUBLE, 'kept': []::STRUCT("start" DOUBLE, "text" VARCHAR)[]}).kept) AS s FROM r)
          SELECT conv_id, s.start AS start, s.text AS text FROM f""")
def keyword_sections(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", (F.col("turn") * 40.0).alias("start"), "text")
    return transcript.sections(rows, "conv_id", "start", "text", ["the", "les"], ["deploy", "first turn"], 120)


@query("""WITH r AS (SELECT conv_id, list({'at': turn::BIGINT, 'len': length(text)::BIGINT} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
          f AS (SELECT conv_id, unnest(list_reduce(l, lambda a, x: {
                  'chunk': CASE WHEN a.sum > 0 AND a.sum + x.len > 600 THEN a.chunk + 1 ELSE a.chunk END,
                  'sum': CASE WHEN a.sum > 0 AND a.sum + x.len > 600 THEN x.len ELSE a.sum + x.len END,
                  'out': list_append(a.out, {'at': x.at, 'chunk': CASE WHEN a.sum > 0 AND a.sum + x.len > 600 THEN a.chunk + 1 ELSE a.chunk END})},
                {'chunk': 0::BIGINT, 'sum': 0::BIGINT, 'out': []::STRUCT("at" BIGINT, chunk BIGINT)[]}).out) AS p FROM r)
          SELECT conv_id, p.at AS turn, p.chunk AS chunk FROM f""")
def greedy_chunks(t: Tables) -> DataFrame:
    return transcript.pack(t.conversations.select("conv_id", "turn", F.length("text").alias("len")), "conv_id", "turn", "len", 600)


@query("""SELECT o_orderkey, o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS finished, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) > 0 AS above FROM orders""")
def per_key_summary(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return t.orders.select("o_orderkey", "o_custkey", F.count_if(F.col("o_orderstatus") == "F").over(w).alias("finished"), (F.col("o_totalprice") - F.avg("o_totalprice").over(w) > 0).alias("above"))


@query("""WITH c AS (SELECT o_custkey, o_orderdate AS s FROM orders WHERE o_orderpriority = '1-URGENT'), i AS (SELECT o_custkey, s, lead(s) OVER (PARTITION BY o_custkey ORDER BY s) AS e FROM (SELECT DISTINCT * FROM c))
          SELECT o.o_orderkey, i.s AS chapter FROM orders o LEFT JOIN i ON o.o_custkey = i.o_custkey AND o.o_orderdate >= i.s AND (i.e IS NULL OR o.o_orderdate < i.e)""")
def interval_join(t: Tables) -> DataFrame:
    o = t.orders
    chapters = o.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderdate").alias("chapter")).distinct()
    return joins.as_of(o.select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("at")), chapters, "o_custkey", "at", ["chapter"]).select("o_orderkey", "chapter")

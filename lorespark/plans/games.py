"""Queries over game logs and transcripts: the events table as games, the conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import transcript
from lorespark.plans import Tables, query
from lorespark.streaming import events as ev
from lorespark.streaming import game

_TYPES = ["next_phase", "unit_shot", "stratagem_used", "unit_moved", "end_turn", "next_phase", "unit_destroyed", "score_points"]
_GAME = f"""g AS (SELECT user_id % 40 AS game_id, event_id::VARCHAR AS id, event_id AS ts, {_TYPES}[event_id % 8 + 1] AS type, (event_id % 5)::VARCHAR AS unit_id, event_id % 2 = 0 AS flag, (event_id % 5 + 1)::INT AS round, (user_id % 2)::INT AS player, (event_id % 7)::INT AS amount FROM events)"""


def _games(t: Tables) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (e % 8 + 1).cast("int"))
    return t.events.select((F.col("user_id") % 40).alias("game_id"), e.cast("string").alias("id"), e.alias("ts"), kind.alias("type"), (e % 5).cast("string").alias("unit_id"), (e % 2 == 0).alias("flag"), F.lit("advance").alias("text"), (e % 5 + 1).cast("int").alias("round"), (F.col("user_id") % 2).cast("int").alias("player"), (e % 7).cast("int").alias("amount"))


@query(f"""WITH {_GAME}, l AS (SELECT game_id, list({{'id': id, 'type': type}} ORDER BY ts) AS l FROM g GROUP BY game_id),
          f AS (SELECT game_id, unnest(list_reduce(l, lambda a, x: {{
             'p': CASE WHEN x.type = 'next_phase' AND a.p < 5 THEN a.p + 1 WHEN x.type = 'end_turn' AND a.p = 5 THEN 0 ELSE a.p END,
             'player': CASE WHEN x.type = 'end_turn' AND a.p = 5 THEN 1 - a.player ELSE a.player END,
             'round': CASE WHEN x.type = 'end_turn' AND a.p = 5 AND a.player = 1 THEN least(a.round + 1, 5) ELSE a.round END,
             'out': CASE WHEN (x.type = 'next_phase' AND a.p < 5) OR (x.type = 'end_turn' AND a.p = 5) OR (x.type = 'unit_moved' AND a.p = 1) OR (x.type = 'unit_shot' AND a.p = 2) OR (x.type = 'unit_destroyed' AND a.p IN (2, 4)) OR (x.type = 'stratagem_used' AND a.p < 5) OR (x.type = 'score_points' AND a.p = 5)
                    THEN list_append(a.out, {{'id': x.id, 'phase': ['command', 'movement', 'shooting', 'charge', 'fight', 'scoring'][a.p + 1], 'player': a.player, 'round': a.round}}) ELSE a.out END}},
             {{'p': 0, 'player': 0, 'round': 1, 'out': []::STRUCT(id VARCHAR, phase VARCHAR, player INT, "round" INT)[]}}).out) AS e FROM l)
          SELECT game_id, e.id AS id, e.phase AS in_phase, e.player AS in_player, e.round AS in_round FROM f""")
def legal_events(t: Tables) -> DataFrame:
    return game.legal_events(_games(t)).select("game_id", "id", "in_phase", "in_player", "in_round")


@query(f"""WITH {_GAME}, n AS (SELECT *, count(*) FILTER (WHERE type = 'end_turn') OVER (PARTITION BY game_id ORDER BY ts, id) AS turn FROM g), m AS (SELECT *, max(turn) OVER (PARTITION BY game_id) AS now FROM n)
          SELECT game_id, unit_id, coalesce(bool_or(turn = now AND type = 'unit_moved'), false) AS advanced, false AS fell_back, coalesce(bool_or(turn = now AND type = 'unit_shot'), false) AS has_shot, false AS has_charged, false AS has_fought FROM m GROUP BY game_id, unit_id""")
def turn_flags(t: Tables) -> DataFrame:
    return game.turn_flags(_games(t))


_CARDS = """c AS (SELECT user_id % 40 AS game_id, (user_id % 2)::INT AS player, event_id AS ts, event_id::VARCHAR AS id, ['draw', 'draw', 'achieve', 'draw', 'discard'][event_id % 5 + 1] AS type, 'c' || (event_id % 6) AS card, (event_id % 4)::INT AS amount, event_id % 2 = 0 AS flag FROM events)"""


def _cards(t: Tables) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("draw", "draw", "achieve", "draw", "discard")]), (e % 5 + 1).cast("int"))
    return t.events.select((F.col("user_id") % 40).alias("game_id"), (F.col("user_id") % 2).cast("int").alias("player"), e.alias("ts"), e.cast("string").alias("id"), kind.alias("type"), F.concat(F.lit("c"), (e % 6).cast("string")).alias("card"), (e % 4).cast("int").alias("amount"), (e % 2 == 0).alias("flag"))


@query(f"""WITH {_CARDS}, l AS (SELECT game_id, player, list({{'type': type, 'card': card, 'amount': amount, 'flag': flag}} ORDER BY ts) AS l FROM c GROUP BY ALL),
          f AS (SELECT game_id, player, list_reduce(l, lambda a, x: CASE
             WHEN x.type = 'draw' AND len(a.hand) < 2 THEN {{'hand': list_append(a.hand, x.card), 'deck': greatest(0, a.deck - 1), 'discarded': a.discarded, 'achieved': a.achieved, 'cp': a.cp, 'vp': a.vp}}
             WHEN x.type = 'discard' THEN {{'hand': list_filter(a.hand, lambda k: k <> x.card), 'deck': a.deck, 'discarded': list_append(a.discarded, x.card), 'achieved': a.achieved, 'cp': CASE WHEN x.flag THEN least(12, a.cp + 1) ELSE a.cp END, 'vp': a.vp}}
             WHEN x.type = 'achieve' THEN {{'hand': list_filter(a.hand, lambda k: k <> x.card), 'deck': a.deck, 'discarded': a.discarded, 'achieved': list_append(a.achieved, x.card), 'cp': a.cp, 'vp': a.vp + x.amount}} ELSE a END,
             {{'hand': []::VARCHAR[], 'deck': 9, 'discarded': []::VARCHAR[], 'achieved': []::VARCHAR[], 'cp': 6, 'vp': 0}}) AS s FROM l)
          SELECT game_id, player, s.hand AS hand, s.deck AS deck, s.discarded AS discarded, s.achieved AS achieved, s.cp AS cp, s.vp AS vp FROM f""")
def card_hands(t: Tables) -> DataFrame:
    return game.card_hands(_cards(t), 9)


def _scored(t: Tables) -> DataFrame:
    e = F.col("event_id")
    kind = F.when((e % 97 == 0), "use_challenger").when(e % 3 == 0, "score_primary").otherwise("achieve")
    return t.events.select((F.col("user_id") % 40).alias("game_id"), (F.floor(F.col("user_id") / 40) % 2).cast("int").alias("player"), kind.alias("type"), (e % 4).cast("int").alias("amount"))


_SCORES = """s AS (SELECT user_id % 40 AS game_id, (user_id // 40 % 2)::INT AS player, CASE WHEN event_id % 97 = 0 THEN 'use_challenger' WHEN event_id % 3 = 0 THEN 'score_primary' ELSE 'achieve' END AS type, event_id % 4 AS amount FROM events),
          k AS (SELECT game_id, player, coalesce(sum(amount) FILTER (WHERE type = 'score_primary'), 0)::BIGINT AS "primary", coalesce(sum(amount) FILTER (WHERE type <> 'score_primary'), 0)::BIGINT AS secondary, bool_or(type = 'use_challenger') AS challenger_used, sum(amount)::BIGINT AS total FROM s GROUP BY ALL)"""


@query(f"WITH {_SCORES} SELECT * FROM k")
def game_scores(t: Tables) -> DataFrame:
    return game.scores(_scored(t))


@query(f"WITH {_SCORES} SELECT k.game_id, k.player FROM k JOIN k o ON k.game_id = o.game_id AND k.player <> o.player WHERE o.total - k.total >= 2 AND NOT k.challenger_used AND k.game_id % 5 > 0")
def eligible_challengers(t: Tables) -> DataFrame:
    table = game.scores(_scored(t))
    decks = table.select("game_id", (F.col("game_id") % 5).alias("cards_left")).distinct()
    return game.eligible_challengers(table, decks, 2)


@query(f"""WITH {_GAME}, r AS (SELECT game_id, unnest([1, 2, 3, 4, 5]) AS round FROM (SELECT DISTINCT game_id FROM g)), e AS (SELECT game_id, round, list(id ORDER BY ts) AS ids FROM g WHERE type = 'unit_shot' AND round < 5 GROUP BY ALL) SELECT r.game_id, r.round, coalesce(ids, []) AS ids FROM r LEFT JOIN e ON r.game_id = e.game_id AND r.round = e.round WHERE r.game_id IN (SELECT game_id FROM e)""")
def events_by_round(t: Tables) -> DataFrame:
    return game.by_round(_games(t).filter("type = 'unit_shot' and round < 5"))


@query("""SELECT s_nationkey AS game_id, (s_suppkey % 2)::INT AS player, count(*) FILTER (WHERE s_acctbal >= 3000) AS remaining, count(*) FILTER (WHERE s_acctbal < 3000) AS lost, coalesce(sum(CASE WHEN s_acctbal < 3000 AND s_suppkey % 3 > 0 THEN s_suppkey % 3 * 50 ELSE 0 END), 0)::BIGINT AS points_lost FROM supplier GROUP BY ALL""")
def player_summaries(t: Tables) -> DataFrame:
    s = t.supplier
    units = s.select(F.col("s_nationkey").alias("game_id"), (F.col("s_suppkey") % 2).cast("int").alias("player"), F.col("s_name").alias("name"), (F.col("s_acctbal") < 3000).alias("destroyed"))
    return game.player_summary(units, s.filter("s_suppkey % 3 > 0").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 3 * 50).alias("points")))


@query("""SELECT n_regionkey AS game_id, 'unit-' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS unit_id, n_name AS name, (n_nationkey % 2)::INT AS player, n_nationkey::INT AS max_wounds, n_nationkey::INT AS wounds, false AS destroyed FROM nation""")
def initial_states(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    units = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name"), (k % 2).cast("int").alias("player"), k.cast("int").alias("wounds")))), lambda x: F.struct(x["name"].alias("name"), x["player"].alias("player"), x["wounds"].alias("wounds")))
    return game.initial_state(t.nation.groupBy(F.col("n_regionkey").alias("game_id")).agg(units.alias("units")))


@query("""SELECT game_id, objective, arg_max(player, (ts, id)) AS player, max(ts) AS since FROM (SELECT user_id % 40 AS game_id, 'o' || (event_id % 6) AS objective, (user_id % 2)::INT AS player, event_id AS ts, event_id::VARCHAR AS id FROM events WHERE event_id % 3 = 0) GROUP BY ALL""")
def objective_owners(t: Tables) -> DataFrame:
    e = _games(t).filter(F.col("ts") % 3 == 0)
    return ev.owners(e.withColumns({"type": F.lit("objective_taken"), "text": F.concat(F.lit("o"), (F.col("ts") % 6).cast("string"))}))


@query("""SELECT conv_id, turn FROM conversations WHERE EXISTS (SELECT 1 FROM (VALUES (300), (600), (900), (1200), (1500), (1800), (2400), (3000), (3600)) s(t) WHERE t > 200 AND turn * 100 >= t AND turn * 100 < t + 120)""")
def sample_windows(t: Tables) -> DataFrame:
    return transcript.sample_windows(t.conversations.withColumn("start", F.col("turn") * 100.0), "start", 200).select("conv_id", "turn")


@query("""SELECT conv_id, left(string_agg(text, ' ' ORDER BY turn), 700) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, floor(turn * 0.7) ORDER BY turn) AS n FROM conversations WHERE turn * 0.7 < 3) WHERE n = 1 GROUP BY conv_id""")
def excerpts(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("start", F.col("turn") * F.lit(0.7).cast("double"))
    return transcript.excerpt(rows, "conv_id", "start", "turn", "text", intro=3, most=700)


@query("""WITH l AS (SELECT conv_id, list({'at': turn::BIGINT, 'len': length(text)::BIGINT} ORDER BY turn) AS l, sum(length(text)) AS total FROM conversations GROUP BY conv_id),
          f AS (SELECT conv_id, list_reduce(l, lambda a, x: CASE WHEN a.n > 0 AND a.sum + x.len > 400 AND total > 500
                  THEN {'first': a.last, 'last': x.at, 'len': x.len, 'sum': a.len + x.len, 'n': 2, 'out': list_append(a.out, {'first': a.first, 'last': a.last, 'n': a.n})}
                  ELSE {'first': coalesce(a.first, x.at), 'last': x.at, 'len': x.len, 'sum': a.sum + x.len, 'n': a.n + 1, 'out': a.out} END,
                {'first': NULL::BIGINT, 'last': NULL::BIGINT, 'len': 0::BIGINT, 'sum': 0::BIGINT, 'n': 0, 'out': []::STRUCT("first" BIGINT, "last" BIGINT, n INT)[]}) AS s FROM l),
          o AS (SELECT conv_id, list_append(s.out, {'first': s.first, 'last': s.last, 'n': s.n}) AS c FROM f), e AS (SELECT conv_id, unnest(c) AS c, unnest(range(0, len(c)))::INT AS chunk FROM o)
          SELECT conv_id, chunk, c.first AS first, c.last AS last, c.n AS n FROM e""")
def overlapping_chunks(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.length("text").alias("len"))
    return transcript.pack_overlapping(rows, "conv_id", "turn", "len", 400, 500)


@query()
def text_chunks(t: Tables) -> DataFrame:
    return transcript.text_chunks(t.documents, "doc_id", "text", 800, 50, 1000, 100)


@query("""WITH s AS (SELECT user_id AS g, event_id % 50 AS start, event_id % 50 + event_id % 7 + 1 AS "end", event_id FROM events), l AS (SELECT g, list({'start': start, 'end': "end", 'event_id': event_id} ORDER BY start - "end", start, "end", event_id) AS l FROM s GROUP BY g),
          f AS (SELECT g, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: x.start < y.end AND y.start < x.end)) > 0 THEN a ELSE list_append(a, x) END, []::STRUCT("start" BIGINT, "end" BIGINT, event_id BIGINT)[])) AS s FROM l)
          SELECT g, s.start AS start, s.end AS "end", s.event_id AS event_id FROM f""")
def longest_spans(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return transcript.longest_spans(t.events.select(F.col("user_id").alias("g"), (e % 50).alias("start"), (e % 50 + e % 7 + 1).alias("end"), e), ["g"])


@query()
def phonetic_scan(t: Tables) -> DataFrame:
    names = t.part.select(F.regexp_replace("p_name", "c", "k").alias("name")).distinct()
    talk = t.part.select("p_partkey", F.concat(F.lit("we saw  "), "p_name", F.lit(" and ran")).alias("text")).filter("p_partkey % 5 = 0")
    common = t.spark.createDataFrame([("we saw",), ("and ran",)], "word string")
    return transcript.phonetic_scan(talk, names, ["p_partkey"], "text", "name", common)


@query("""WITH m AS (SELECT role, conv_id % 7 AS k, list_sort(list(DISTINCT turn * 50 + conv_id)) AS s FROM conversations GROUP BY ALL),
          l AS (SELECT role, s[1] AS first, 'n' || k AS name, 'n' || k || ': ' || array_to_string(list_transform(s[1:5], lambda x: (x // 60) || ':' || lpad((x % 60)::VARCHAR, 2, '0')), ', ') || CASE WHEN len(s) > 5 THEN '... (' || len(s) || ' total mentions)' ELSE '' END AS line FROM m WHERE len(s) > 0 AND s[1] < 3600)
          SELECT role, string_agg(line, chr(10) ORDER BY first, name) AS lines FROM l GROUP BY role""")
def timelines(t: Tables) -> DataFrame:
    rows = t.conversations.select("role", F.concat(F.lit("n"), (F.col("conv_id") % 7).cast("string")).alias("name"), (F.col("turn") * 50 + F.col("conv_id")).alias("ts"))
    index = transcript.mention_index(rows, "role", "name", "ts").filter("first_second < 3600")
    return transcript.timelines(index, "role", "name")

"""Battle reports: entity names checked against a catalogue, repaired, enriched and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import rules, text
from lorespark.functions.similarity import bare, bigrams
from lorespark.operators.approx import approximate_search
from lorespark.operators.integrity import misclassified
from lorespark.operators.match import containment_pairs, entries, phonetic_pairs, similarity_join, whole

# From which score a fuzzy hit, a phonetic hit and a suggestion count, and what two matchers that agree are worth.
FUZZY_OK, PHONETIC_OK, PHONETIC_LEAST, SUGGESTED, AGREED = 0.6, 0.5, 0.4, 0.3, 0.7


def _best(pairs: DataFrame, by: list[str], name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), name)
    return pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def validate_names(names: DataFrame, official: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(scope, name, matched, confidence, is_validated, suggestion, suggestion_score) of distinct (scope, name).

    official: scope, official. Within its scope a name takes its best fuzzy
    match from 0.6 on; otherwise its best phonetic one from 0.4 on, which is
    worth 0.7 at least if it is the best fuzzy match too, and valid from 0.5
    on. The better of both is the suggestion, from 0.3 on. Dice similarity
    stands in for the fuzzy scorer.
    """
    n, o = names.select("scope", "name").distinct(), official.select("scope", "official").distinct()
    within = lambda pairs: pairs.join(n, "name").join(o, ["scope", "official"]).select("scope", "name", "official", "score")
    fuzzy = _best(within(similarity_join(n, o, "name", "official", SUGGESTED)), ["scope", "name"], "official").select("scope", "name", F.col("official").alias("f"), F.col("score").alias("fs"))
    sound = _best(within(phonetic_pairs(n, o, "name", "official", SUGGESTED, overrides)), ["scope", "name"], "official").select("scope", "name", F.col("official").alias("p"), F.col("score").alias("ps"))
    both = n.join(fuzzy, ["scope", "name"], "left").join(sound, ["scope", "name"], "left")
    by_fuzzy = F.coalesce(F.col("fs") >= FUZZY_OK, F.lit(False))
    by_sound = ~by_fuzzy & F.coalesce(F.col("ps") >= PHONETIC_LEAST, F.lit(False))
    agreed = F.when(F.lower("f") == F.lower("p"), F.greatest("ps", "fs", F.lit(AGREED))).otherwise(F.col("ps"))
    confidence = F.when(by_fuzzy, F.col("fs")).when(by_sound, agreed).otherwise(F.coalesce("fs", F.lit(0.0)))
    valid = by_fuzzy | (by_sound & (agreed >= PHONETIC_OK))
    told = both.withColumns({"confidence": confidence, "is_validated": F.coalesce(valid, F.lit(False)), "better": F.coalesce(F.col("fs") >= F.col("ps"), F.col("fs").isNotNull())})
    matched = F.when(F.col("is_validated"), F.when(by_fuzzy, F.col("f")).otherwise(F.col("p")))
    return told.select("scope", "name", matched.alias("matched"), "confidence", "is_validated", F.when(F.col("better"), F.col("f")).otherwise(F.col("p")).alias("suggestion"), F.when(F.col("better"), F.col("fs")).otherwise(F.col("ps")).alias("suggestion_score"))


def check_names(names: DataFrame, official: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(scope, name, matched, confidence, is_validated) of distinct (scope, name), by approximate search in the official names of the scope.

    official: scope, official, and, where there is one, canonical. The best hit
    holds from a confidence (1 - score) of 0.6 on; else the best phonetic one
    from 0.4 on, which counts 0.7 at least where both are the same name and is
    valid from 0.5 on; else the hit's own confidence stands, not valid.
    """
    n, fuzzy, sound = _both_searches(names, official, overrides, PHONETIC_LEAST)
    best = _best(fuzzy, ["scope", "name"], "official").select("scope", "name", F.col("official").alias("f"), F.col("score").alias("fs"))
    heard = _best(sound, ["scope", "name"], "official").select("scope", "name", F.col("official").alias("p"), F.col("score").alias("ps"))
    both = n.join(best, ["scope", "name"], "left").join(heard, ["scope", "name"], "left")
    by_fuzzy = F.coalesce(F.col("fs") >= FUZZY_OK, F.lit(False))
    agreed = F.when(F.lower("f") == F.lower("p"), F.greatest("ps", "fs", F.lit(AGREED))).otherwise(F.col("ps"))
    by_sound = ~by_fuzzy & F.coalesce(agreed >= PHONETIC_OK, F.lit(False))
    confidence = F.when(by_fuzzy, F.col("fs")).when(F.col("ps").isNotNull(), agreed).otherwise(F.coalesce("fs", F.lit(0.0)))
    return both.select("scope", "name", F.when(by_fuzzy, F.col("f")).when(by_sound, F.col("p")).alias("matched"), confidence.alias("confidence"), (by_fuzzy | by_sound).alias("is_validated"))


def _both_searches(names: DataFrame, official: DataFrame, overrides: DataFrame | None, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct names, and the pairs (scope, name, official, score) of the approximate and of the phonetic search."""
    n = names.select("scope", "name").distinct()
    known = official if "canonical" in official.columns else official.withColumn("canonical", text.slugify(F.col("official")))
    hits = approximate_search(n, known.select("scope", "official", "canonical"), "name", {"official": 0.7, "canonical": 0.3}, ["scope"])
    fuzzy = hits.groupBy("scope", "name", "official").agg((1 - F.min("score")).alias("score"))
    o = official.select("scope", "official").distinct()
    sound = phonetic_pairs(n, o, "name", "official", least, overrides).join(n, "name").join(o, ["scope", "official"]).select("scope", "name", "official", "score")
    return n, fuzzy, sound


def name_suggestions(names: DataFrame, official: DataFrame, overrides: DataFrame | None = None, k: int = 5) -> DataFrame:
    """(scope, name, rank, suggestion, confidence): for names that check_names() is not sure of, the best of the k best hits of both
    searches (phonetic ones from 0.3 on), each official name once with its better confidence, ties by name."""
    checked = check_names(names, official, overrides).filter((F.col("confidence") < FUZZY_OK) | ~F.col("is_validated"))
    _, fuzzy, sound = _both_searches(checked, official, overrides, SUGGESTED)
    order = Window.partitionBy("scope", "name").orderBy(F.col("score").desc(), "official")
    top = lambda pairs: pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
    merged = top(fuzzy).unionByName(top(sound)).groupBy("scope", "name", "official").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("scope", "name", "rank", F.col("official").alias("suggestion"), F.col("score").alias("confidence"))


def process_entities(entities: DataFrame, official: DataFrame, mappings: DataFrame, kind: str, overrides: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """Entities (scope, name, level and other columns) cleaned, mapped, validated and re-rated.

    A closing remark in brackets goes; a user's mapping (alias, kind, scope,
    canonical; the own scope before a null one) replaces the name before it is
    checked; a valid name takes its match and a better level, another one a
    lower level and a suggestion. Without official names in its scope an
    entity just gets a lower level. drop: names that are no such entities.
    """
    e = entities.withColumn("name", text.strip_last_parentheses(F.col("name")))
    if drop is not None:
        e = e.join(drop.select(F.lower(F.trim("name")).alias("_d")).distinct(), F.lower(F.trim("name")) == F.col("_d"), "left_anti")
    m = mappings.filter(F.col("kind") == kind).select(F.lower("alias").alias("_a"), F.col("scope").alias("_s"), "canonical")
    alias = F.lower(F.trim("name"))
    own = m.filter("_s is not null").groupBy("_a", "_s").agg(F.min("canonical").alias("_own"))
    general = m.filter("_s is null").groupBy(F.col("_a").alias("_g")).agg(F.min("canonical").alias("_general"))
    mapped = e.join(own, (alias == F.col("_a")) & (F.col("scope") == F.col("_s")), "left").join(general, alias == F.col("_g"), "left")
    asked = mapped.withColumn("asked", F.coalesce("_own", "_general", "name")).drop("_a", "_s", "_own", "_g", "_general")
    checked = validate_names(asked.select("scope", F.col("asked").alias("name")), official, overrides).withColumnRenamed("name", "asked")
    known = official.select("scope").distinct().withColumn("_known", F.lit(True))
    out = asked.join(checked, ["scope", "asked"], "left").join(known, "scope", "left")
    ok = F.coalesce("is_validated", F.lit(False)) & F.coalesce("_known", F.lit(False))
    level = F.when(ok, rules.boost_confidence(F.col("level"), F.col("confidence"))).otherwise(rules.lower_confidence(F.col("level")))
    hint = ~ok & F.coalesce("_known", F.lit(False)) & (F.col("suggestion_score") >= SUGGESTED)
    return out.select(*[c for c in entities.columns if c not in ("name", "level")], F.when(ok, F.col("matched")).otherwise(F.col("name")).alias("name"), level.alias("level"), ok.alias("is_validated"), F.when(hint, F.col("suggestion")).alias("suggestion"))


def feedback(entities: DataFrame) -> DataFrame:
    """What a user is asked: entities that are not valid, with their suggestions; one row per scope and name in any case."""
    return entities.filter(~F.col("is_validated")).groupBy("scope", F.lower("name").alias("token")).agg(F.min("name").alias("name"), F.max("suggestion").alias("suggestion"), F.count(F.lit(1)).alias("n"))


def enrich_units(units: DataFrame, catalogue: DataFrame) -> DataFrame:
    """units (scope, name, points, ...) with the catalogue's (scope, official, db_points, ...) columns of the row that a name means.

    Names of other things, and names that mean no row, are left out. A row of
    the own scope is meant by its name without case, then by part of its name;
    shorter official names first. The catalogue's points replace the unit's.
    """
    u = units.filter(~misclassified(F.col("name"))).withColumn("_id", F.monotonically_increasing_id())
    c = catalogue.withColumnRenamed("scope", "_scope")
    exact = u.join(c, (F.col("scope") == F.col("_scope")) & (F.lower("name") == F.lower("official"))).withColumn("_tier", F.lit(0))
    # Distinct names meet the official ones that hold them by their rarest letters; names without letters and digits are compared with all of their scope.
    sides = [df.select(k).distinct().withColumn("_x", bare(F.col(k))) for df, k in ((u, "name"), (c, "official"))]
    held = containment_pairs(*sides, "name", "official").select("name", F.col("official").alias("_holder"))
    holds = (F.col("scope") == F.col("_scope")) & F.contains(F.lower("official"), F.lower("name"))
    part = u.join(held, "name").join(c, (F.col("_holder") == F.col("official")) & holds).drop("_holder").select(*exact.columns[:-1])
    part = part.unionByName(u.filter(bare(F.col("name")) == "").join(c, holds)).withColumn("_tier", F.lit(1))
    first = Window.partitionBy("_id").orderBy("_tier", F.length("official"), "official")
    best = exact.unionByName(part).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return best.withColumn("points", F.coalesce("db_points", "points")).drop("_id", "_scope", "_tier", "_n", "db_points")


def name_tier(name: Column, mention: Column) -> Column:
    """How a name and a mention agree: 0 equal, 1 one is part of the other or half of the shorter one's words longer than two letters are shared; null not at all."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) > 2)
    shared = F.size(F.array_intersect(words(name), words(mention)))
    half = (shared >= 1) & (2 * shared >= F.least(F.size(words(name)), F.size(words(mention))))
    return F.when(name == mention, 0).when(F.contains(mention, name) | F.contains(name, mention) | half, 1)


def _meeting(x: Column, mine: str, theirs: str) -> Column:
    """What a text is met by: its words longer than two letters, the rarest of its bigrams as a part of another text, all that it has as one that holds another."""
    grams = bigrams(x)
    none = F.array().cast("array<string>")
    empty = F.when(x == "", F.array(F.lit(""))).otherwise(none)
    letters = F.when(x == "", none).otherwise(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1))))
    words = F.array_distinct(F.filter(F.split(x, " "), lambda w: F.length(w) > 2))
    return F.concat(entries("word", words), entries(mine, F.concat(whole(x, grams), empty)), entries(theirs, F.array_distinct(F.concat(grams, letters, F.array(F.lit(""))))))


def fill_mentions(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """entities (report, name, ts, ...) with ts and mention_count from a report's mentions (report, place, mention, seconds: sorted).

    A missing ts is the first second of the equal mention, or else of the
    first one in order of place that agrees; the count is that of the equal
    mention, or else the largest of those that agree; a ts that is there stays.

    Names and mentions are taken distinct in their report first, each mention
    with its first place and its largest count, and meet by a word that they
    share or by the rarest bigram of the one that is part of the other, so that
    repeated names cost a comparison once and only likely pairs are compared.
    """
    e = entities.withColumns({"_r": F.col("report"), "_name": text.normalize_term(F.col("name"))})
    first = F.min(F.struct(F.col("place"), F.col("seconds")[0].alias("second")))
    told = mentions.groupBy(F.col("report").alias("_r"), "mention").agg(first.alias("first"), F.max(F.size("seconds")).alias("n"))
    names = e.select("_r", "_name").distinct()
    name, mention = F.col("_name"), F.col("mention")
    met = names.select("_r", "_name", F.explode(_meeting(name, "in_mention", "in_name")).alias("e")).select("_r", "_name", "e.*")
    by = told.select("_r", "mention", F.explode(_meeting(mention, "in_name", "in_mention")).alias("e")).select("_r", "mention", "e.*")
    pairs = met.join(by, ["_r", "kind", "g"]).select("_r", "_name", "mention").distinct().withColumn("tier", name_tier(name, mention)).filter("tier is not null")
    equal = F.max(F.when(F.col("tier") == 0, F.col("n")))
    best = pairs.join(told, ["_r", "mention"]).groupBy("_r", "_name").agg(F.min_by("first.second", F.struct("tier", "first")).alias("_ts"), F.coalesce(equal, F.max("n")).alias("mention_count"))
    return e.join(best, ["_r", "_name"], "left").withColumn("ts", F.coalesce("ts", "_ts")).drop("_r", "_name", "_ts")


def repair_detachments(players: DataFrame, transcripts: DataFrame, detachments: DataFrame) -> DataFrame:
    """players (report, place, faction, detachment) with unknown detachments taken from what their report's transcript (report, text) names.

    detachments: faction, detachment. Of the named ones of a player's faction
    the longest goes to the first player of the report that lacks one, the
    next to the next; no name serves twice. One fold per report over its few
    players.
    """
    unknown = F.coalesce(F.col("detachment").isin("", "Unknown"), F.lit(True))
    open_ = players.filter(unknown).select("report", "place", F.lower("faction").alias("f"))
    named = detachments.select(F.lower("faction").alias("df"), F.col("detachment").alias("found")).distinct()
    fits = F.contains("f", F.col("df")) | F.contains("df", F.col("f"))
    factions = open_.select("f").distinct().join(named, fits)
    told = transcripts.select("report", F.lower("text").alias("_t"))
    hits = open_.join(factions, "f").join(told, "report").filter(F.contains("_t", F.lower("found"))).select("report", "place", "found").distinct()
    row = F.struct((-F.length("found")).alias("short"), "found")
    lists = hits.groupBy("report", "place").agg(F.array_sort(F.collect_list(row)).alias("all")).groupBy("report").agg(F.array_sort(F.collect_list(F.struct("place", "all"))).alias("players"))
    fold = F.expr(
        """aggregate(players, named_struct('used', cast(array() as array<string>), 'out', cast(array() as array<struct<place:int,found:string>>)), (a, p) ->
             case when size(filter(p.all, x -> not array_contains(a.used, x.found))) = 0 then a
             else named_struct('used', concat(a.used, array(element_at(filter(p.all, x -> not array_contains(a.used, x.found)), 1).found)),
                               'out', concat(a.out, array(named_struct('place', cast(p.place as int), 'found', element_at(filter(p.all, x -> not array_contains(a.used, x.found)), 1).found)))) end, a -> a.out)"""
    )
    given = lists.select("report", F.explode(fold).alias("g")).select("report", "g.place", "g.found")
    return players.join(given, ["report", "place"], "left").withColumn("detachment", F.coalesce("found", "detachment")).drop("found")


def check_detachments(players: DataFrame, detachments: DataFrame) -> DataFrame:
    """players with a detachment of their faction: their own if the catalogue has it in any case, else the first by name that holds it or is held, else Unknown; players of factions that the catalogue lacks keep theirs."""
    d = detachments.select(F.lower("faction").alias("_f"), F.col("detachment").alias("_d")).distinct()
    low, official = F.lower("detachment"), F.lower("_d")
    tier = F.when(low == official, 0).when(F.contains(official, low) | F.contains(low, official), 1)
    met = players.join(d, F.lower("faction") == F.col("_f"), "left").withColumn("_tier", tier)
    best = F.min_by(F.when(F.col("_tier") == 0, F.col("detachment")).otherwise(F.col("_d")), F.when(F.col("_tier").isNotNull(), F.struct("_tier", "_d")))
    told = met.groupBy("report", "place").agg(best.alias("_best"), F.max(F.col("_f").isNotNull()).alias("_known"))
    out = players.join(told, ["report", "place"])
    return out.withColumn("detachment", F.when(F.col("_known"), F.coalesce("_best", F.lit("Unknown"))).otherwise(F.col("detachment"))).drop("_best", "_known")


def check_mappings(mappings: DataFrame, validated: DataFrame, names: DataFrame, drop_kinds: list[str], least: float = 0.7) -> DataFrame:
    """mappings (report, colloquial, official) corrected and cut to what a report may use.

    validated: official, match, kind, score; a hit of a dropped kind removes
    the mapping, another one from ``least`` on replaces the official name.
    names: report (null: any), name; a mapping stays if its name is one of
    them, and all of a report without names of its own stay.
    """
    v = validated.filter(F.col("score") >= least).groupBy(F.lower("official").alias("_o")).agg(F.min_by("match", F.struct(-F.col("score"), "match")).alias("_m"), F.max(F.col("kind").isin(drop_kinds)).alias("_drop"))
    fixed = mappings.join(v, F.lower("official") == F.col("_o"), "left").filter(~F.coalesce("_drop", F.lit(False)))
    fixed = fixed.select("report", "colloquial", F.coalesce("_m", "official").alias("official"))
    low = names.select("report", F.lower("name").alias("_n")).distinct()
    own, any_ = low.filter("report is not null"), low.filter("report is null").select("_n")
    limited = fixed.join(own.select("report").distinct(), "report", "left_semi")
    is_own = limited.join(own, (limited["report"] == own["report"]) & (F.lower("official") == F.col("_n")), "left_semi")
    is_any = limited.join(any_, F.lower("official") == F.col("_n"), "left_semi")
    return is_own.union(is_any).distinct().union(fixed.join(own.select("report").distinct(), "report", "left_anti"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """One row: alerts by level and the exit code, 2 with a critical one, 1 with an error, else 0."""
    n = lambda level: F.count_if(F.col("level") == level).alias(level)
    out = alerts.agg(*[n(x) for x in ("info", "warning", "error", "critical")])
    return out.withColumn("exit_code", F.when(F.col("critical") > 0, 2).when(F.col("error") > 0, 1).otherwise(0))

"""Fuzzy lookup of names: a blocked similarity join, and the chain alias, exact, phonetic, fuzzy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import phonetic, text
from lorespark.functions.similarity import bare, bigrams, dice_of
from lorespark.operators.walks import walk
from lorespark.scratch import Scratch

# Thresholds of the matchers.
FUZZY, PHONETIC, PHONETIC_LOW = 0.7, 0.5, 0.4
#: So many of a query's longest words are looked up in all words of the texts.
LONGEST = 3


#: Letters and digits from common to rare; names meet by the rarest of their units in this fixed order.
COMMON_FIRST = "etaoinsrhldcumfpgwybvkxjqz0123456789"


def _units(grams: Column, bare_text: Column, with_letters: Column | bool) -> Column:
    """What a name can be met by: bigrams, a single character's own, and all characters where one may be the whole of the other name."""
    letters = F.array_distinct(F.split(bare_text, "(?<=.)(?=.)"))
    return F.when(F.length(bare_text) == 1, F.array(bare_text)).when(F.lit(with_letters), F.concat(grams, letters)).otherwise(grams)


def _rarest_first(units: Column) -> Column:
    at = lambda u, i: F.instr(F.lit(COMMON_FIRST), F.substring(u, i, 1))
    return F.transform(F.array_sort(F.transform(units, lambda u: F.struct((-at(u, 1) - at(u, 2)).alias("r"), u.alias("u")))), lambda x: x["u"])


def entries(kind: str, units: Column) -> Column:
    return F.transform(units, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("g")))


def whole(x: Column, grams: Column) -> Column:
    """The rarest unit of a name, as an array; empty for an empty name."""
    return F.slice(_rarest_first(_units(grams, x, False)), 1, 1)


def containment_pairs(shorter: DataFrame, longer: DataFrame, short_key: str, long_key: str) -> DataFrame:
    """Pairs in which a name's bare text (column _x; not empty) is part of the other's.

    A name meets the longer ones by the rarest of its units, so common bigrams are no hot keys.
    """
    x = F.col("_x")
    s = shorter.filter("_x <> ''").select(short_key, "_x", F.explode(whole(x, bigrams(x))).alias("g"))
    l = longer.select(long_key, x.alias("_y"), F.explode(_units(bigrams(x), x, True)).alias("g"))  # noqa: E741
    return s.join(l, "g").filter(F.contains("_y", x)).select(short_key, long_key).distinct()


def similarity_join(terms: DataFrame, candidates: DataFrame, term: str, name: str, least: float) -> DataFrame:
    """Pairs (term, candidate) of Dice similarity of at least ``least`` > 0, with column score.

    Both sides are taken distinct first, so a hot name is scored once. Names
    whose sets of bigrams are alike enough share one of their rarest bigrams
    (prefix filtering), and a name that is part of another meets it by its
    rarest one; only such pairs, of sizes that allow the score, are scored.
    One join finds them all.
    """
    share = least / (2.0 - least) - 1e-9  # of a set's bigrams are in any set that is alike enough
    x = F.col("_x")

    def side(df: DataFrame, key: str, probe: str, meet: str, n: int) -> DataFrame:
        grams = bigrams(x)
        prefix = F.slice(_rarest_first(grams), F.lit(1), F.size(grams) - F.ceil(F.size(grams) * F.lit(share)).cast("int") + 1)
        open_ = _units(grams, x, F.length(x) <= 1.0 / least)
        bare_names = F.when(x == "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        all_ = F.concat(entries("alike", prefix), entries(probe, whole(x, grams)), entries(meet, open_), entries("empty", bare_names))
        return df.select(key).distinct().withColumn("_x", bare(F.col(key))).select(key, x.alias(f"_x{n}"), F.size(grams).alias(f"_n{n}"), F.explode(all_).alias("e")).select(key, f"_x{n}", f"_n{n}", "e.kind", "e.g")

    met = side(terms, term, "in_name", "in_term", 1).join(side(candidates, name, "in_term", "in_name", 2), ["kind", "g"])
    inside = lambda a, b: F.contains(b, a) & (F.length(a) >= least * F.length(b))
    kind, x1, x2 = F.col("kind"), F.col("_x1"), F.col("_x2")
    near = (kind == "alike") & (F.least("_n1", "_n2") >= share * F.greatest("_n1", "_n2"))
    likely = met.filter(near | ((kind == "in_name") & inside(x1, x2)) | ((kind == "in_term") & inside(x2, x1)) | (kind == "empty"))
    pairs = likely.select(term, name, "_x1", "_x2").distinct()
    scored = pairs.withColumn("score", dice_of(x1, x2, bigrams(x1), bigrams(x2)))
    return scored.filter(F.col("score") >= least).select(term, name, "score")


def top_matches(pairs: DataFrame, term: str, name: str, k: int) -> DataFrame:
    """The k best of each term, ties by name."""
    order = Window.partitionBy(term).orderBy(F.col("score").desc(), name)
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_similar(terms: DataFrame, candidates: DataFrame, term: str, name: str, k: int, least: float, steps: tuple[float, ...] = (0.85, 0.7, 0.55, 0.4)) -> DataFrame:
    """(term, name, score, rank): the k candidates most alike to each term, from ``least`` on, ties by name.

    The bound falls step by step. A term that has k candidates at a bound has
    its best ones, since all others score less; only terms that are still short
    of k go on to the next bound, where prefixes are longer and more pairs meet.
    """
    scratch = Scratch(terms.sparkSession, "top_similar")
    open_, found = scratch.write(terms.select(term).distinct(), "terms"), []
    for i, bound in enumerate([*[s for s in steps if s > least], least]):
        pairs = scratch.write(similarity_join(open_, candidates, term, name, bound), f"pairs{i}")
        if bound == least:
            return top_matches(reduce(DataFrame.unionByName, [*found, pairs]), term, name, k)
        full = scratch.write(pairs.groupBy(term).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(term), f"full{i}")
        found.append(pairs.join(full, term, "left_semi"))
        open_ = scratch.write(open_.join(full, term, "left_anti"), f"open{i}")


def phonetic_pairs(terms: DataFrame, candidates: DataFrame, term: str, name: str, least: float, overrides: DataFrame | None = None) -> DataFrame:
    """Pairs with an equal sound code; score is the mean of the best equal code's base score and of the codes' similarity.

    A term's primary Double Metaphone meets primaries, its secondary one
    secondaries that differ from their primary, and so on for the other codes.
    overrides (variation, canonical), known mishearings: a term that is a
    variation of a candidate's name gets that name alone, at 0.95.
    """
    coded = lambda df, c, n: df.select(c).distinct().withColumn(n, phonetic.codes(F.col(c)))
    t, k = coded(terms, term, "_a"), coded(candidates, name, "_b")
    # Base scores of an equal code.
    kinds = {"primary": 0.9, "secondary": 0.7, "metaphone": 0.6, "soundex": 0.4}
    each = lambda df, c, n, own: df.select(c, n, F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.when(own(i), F.col(f"{n}.{i}")).alias("code"), F.lit(b).alias("base")) for i, b in kinds.items()])).alias("x")).select(c, n, "x.*").filter("code <> ''")
    named = each(k, name, "_b", lambda i: F.col("_b.secondary") != F.col("_b.primary") if i == "secondary" else F.lit(True)).drop("base")
    met = each(t, term, "_a", lambda i: F.lit(True)).join(named, ["kind", "code"]).groupBy(term, name).agg(F.max("base").alias("base"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    scored = met.withColumn("score", (F.col("base") + phonetic.similarity(F.col("_a"), F.col("_b"))) / 2).select(term, name, "score")
    if overrides is not None:
        low = lambda c: F.lower(F.trim(c))
        first = overrides.groupBy(low("variation").alias("_v")).agg(F.min(low("canonical")).alias("_c"))
        known = terms.select(term).distinct().join(first, low(term) == F.col("_v")).join(candidates.select(name).distinct(), F.lower(name) == F.col("_c")).select(term, name, F.lit(0.95).alias("score"))
        scored = scored.join(known.select(term).distinct(), term, "left_anti").unionByName(known)
    return scored.filter(F.col("score") >= least)


def first_containing(terms: DataFrame, candidates: DataFrame, term: str, name: str, order: str) -> DataFrame:
    """(term, name) of the first candidate in order whose lower-case text is part of the term's or has it as a part; empty names are left out."""
    sides = lambda df, c: df.select(c).filter(F.trim(c) != "").withColumn("_x", bare(F.col(c)))
    t, c = sides(terms.select(term).distinct(), term), sides(candidates, name)
    pairs = containment_pairs(t, c, term, name).select(term, name).union(containment_pairs(c, t, name, term).select(term, name))
    ranked = pairs.join(candidates.select(name, order), name)
    low, t_low = F.lower(name), F.lower(F.trim(term))
    return ranked.filter(F.contains(low, t_low) | F.contains(t_low, low)).groupBy(term).agg(F.min_by(name, F.struct(order, name)).alias(name))


def match_chain(terms: DataFrame, candidates: DataFrame, aliases: DataFrame, term: str = "term", name: str = "name", least: float = FUZZY, overrides: DataFrame | None = None) -> DataFrame:
    """One row per distinct term: the name, matcher and score of the first matcher that is sure enough.

    aliases: alias, canonical (unique lower-case aliases). candidates may have
    a column ``place``, their order; else they are in order of name. Matchers
    in order: alias, exact, phonetic, fuzzy (the first candidate that contains
    the term or is contained, if it is like enough, else the one most alike),
    phonetic at its lower threshold; each hit needs ``least`` as well. Terms
    without a match keep null.
    """
    t = terms.select(term).distinct()
    c = (candidates if "place" in candidates.columns else candidates.withColumn("place", F.col(name))).groupBy(name).agg(F.min("place").alias("place"))
    low = F.lower(F.trim(F.col(term)))
    first = c.groupBy(F.lower(name).alias("_low")).agg(F.min_by(name, F.struct("place", name)).alias(name))
    hit = lambda df, step, matcher, score="score": df.select(term, name, (F.col(score) if isinstance(score, str) else F.lit(score)).alias("score"), F.lit(step).alias("step"), F.lit(matcher).alias("matcher"))
    scratch, keep = Scratch(terms.sparkSession, "match_chain"), [term, name, "score", "place", "step", "matcher"]
    placed = lambda df: df.join(c, name, "left")
    sure = hit(t.join(aliases.select(F.col("alias").alias("_low"), F.col("canonical").alias(name)), low == F.col("_low")), 0, "alias", 1.0).union(hit(t.join(first, low == F.col("_low")), 1, "exact", 1.0))
    # A matcher sees only the terms that none before it was sure of; pairs that two of them need are made once.
    sure = scratch.write(sure.filter(F.col("score") >= least), "sure")
    open_ = scratch.write(t.join(sure.select(term).distinct(), term, "left_anti"), "open")
    sound = scratch.write(phonetic_pairs(open_, c, term, name, PHONETIC_LOW, overrides).filter(F.col("score") >= least), "sound")
    heard = sound.filter(F.col("score") >= PHONETIC)
    left = scratch.write(open_.join(heard.select(term).distinct(), term, "left_anti"), "left")
    fuzzy = scratch.write(similarity_join(left, c, term, name, least), "fuzzy")
    inside = fuzzy.join(first_containing(fuzzy.select(term).distinct(), c, term, name, "place"), [term, name])
    hits = sure.union(hit(heard, 2, "phonetic")).union(hit(inside, 3, "fuzzy")).union(hit(fuzzy.filter(F.col("score") > least), 4, "fuzzy"))
    hits = hits.union(hit(sound.join(left, term, "left_semi"), 5, "phonetic_fallback"))
    best = Window.partitionBy(term).orderBy("step", F.col("score").desc(), F.col("place").asc_nulls_last(), name)
    top = placed(hits).select(*keep).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(term, name, "score", "matcher")
    return t.join(top, term, "left")


def detect_mentions(segments: DataFrame, dictionary: DataFrame, by: list[str], words: int = 3) -> DataFrame:
    """Mentions of dictionary terms in texts: runs of up to ``words`` words joined to the dictionary.

    segments: by..., text. dictionary: term (normalised, unique), canonical,
    kind. Where runs of one segment overlap, the leftmost, then the longest is
    taken, for runs of at most three words decided by comparing neighbours.
    """
    split = segments.withColumn("_w", F.split(text.normalize_string(F.col("text")), " "))
    runs = F.flatten(
        F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size("_w") - i + 1)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(F.col("_w"), i, n), " ").alias("term"))))
    )
    grams = split.select(*by, F.explode(runs).alias("g")).select(*by, "g.*")
    return grams.join(dictionary, "term").select(*by, "at", "n", "term", "canonical", "kind")


def longest_first(mentions: DataFrame, by: list[str]) -> DataFrame:
    """Non-overlapping mentions of each segment: in order of start, longer first, each kept if it starts after the last kept one ends."""
    told = mentions.select(*by, "at", "n", "term", "canonical", "kind", (-F.col("n")).alias("_short"))
    step = lambda end, row: (row[0] + row[1], ()) if row[0] >= end else (end, None)
    return walk(told, by, ["at", "_short", "term", "canonical", "kind"], ["at", "n"], lambda: 0, step, "").drop("_short")


def word_parts(queries: DataFrame, texts: DataFrame, query: str, text: str, words: str) -> DataFrame:
    """Pairs of a query and a text whose words (distinct, of a-z and 0-9) include every word of the query or have it as a part; queries without words meet nothing.

    Of its longest words, which are part of few others, a query meets texts by
    that which is part of words of fewest texts; the pairs found so are looked
    up word by word, longest first, in the text's words. Words are taken out of
    the texts once.
    """
    scratch = Scratch(texts.sparkSession, "word_parts")
    told = scratch.write(texts.select(text, F.col(words).alias("_w")), "texts")
    known = scratch.write(told.select(F.explode("_w").alias("known")).groupBy("known").agg(F.count(F.lit(1)).alias("n")), "known")
    by_length = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("short"), w.alias("w")))), lambda x: x["w"])
    asked_of = queries.select(query, by_length.alias("_q"))
    asked = asked_of.select(query, F.explode(F.slice("_q", 1, LONGEST)).alias("asked"))
    unit = lambda df, c: df.select(c, F.col(c).alias("_x"))
    parts = scratch.write(containment_pairs(unit(asked.select("asked").distinct(), "asked"), unit(known, "known"), "asked", "known"), "parts")
    often = parts.join(known, "known").groupBy("asked").agg(F.sum("n").alias("n"))
    # A word that no text has makes its query meet nothing: it is the rarest.
    rarest = asked.join(often, "asked", "left").groupBy(query).agg(F.min_by("asked", F.struct(F.coalesce("n", F.lit(0)), "asked")).alias("asked"))
    by = scratch.write(rarest.join(parts, "asked").select(query, "known"), "by")
    met = scratch.write(told.select(text, F.explode("_w").alias("known")).join(by, "known").select(query, text).distinct(), "met")
    # Words have no blanks, so a word is part of one of the text's where it is part of all of them in a row.
    both = met.join(asked_of, query).join(told.select(text, F.array_join("_w", " ").alias("_t")), text)
    return both.filter(F.forall("_q", lambda q: F.contains(F.col("_t"), q))).select(query, text)

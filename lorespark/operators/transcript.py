"""Time-stamped text: windows, sections, chunks and mentions."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.walks import each_text, walk

#: Words of a text, by the white space of ASCII.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def drop_repeats(segments: DataFrame, by: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Segments whose trimmed text differs from the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(F.trim(text)).over(w)
    return segments.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.trim(text))).drop("_b")


def first_per_second(segments: DataFrame, by: list[str], start: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by, F.floor(start)).orderBy(*order)
    return segments.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def gap_groups(rows: DataFrame, by: list[str], ts: str, gap: float, order: list[str]) -> DataFrame:
    """rows with session, which grows by one where the time since the row before is at least ``gap``."""
    w = Window.partitionBy(*by).orderBy(*order)
    opens = F.coalesce((F.col(ts) - F.lag(ts).over(w) >= gap).cast("int"), F.lit(0))
    return rows.withColumn("_o", opens).withColumn("session", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def sections(segments: DataFrame, by: str, start: str, text: str, openers: list[str], closers: list[str], seconds: int) -> DataFrame:
    """(by, start, text) of the segments inside keyword-opened sections.

    A segment with an opener opens a section where none is open; segments are
    taken until one starts more than ``seconds`` after the opening or has a
    closer, that one included.
    """
    low = F.lower(text)
    hit = lambda words: F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(low, x))
    told = segments.select(by, F.col(start).alias("_s"), F.col(text).alias("_t"), F.coalesce(hit(openers), F.lit(False)).alias("_o"), F.coalesce(hit(closers), F.lit(False)).alias("_c"))

    def step(state: tuple[bool, float], row: tuple) -> tuple:
        (open_, until), (at, opens, closes) = state, row
        if not open_ and opens:
            open_, until = True, at + seconds
        return (open_ and not (at > until or closes), until), () if open_ else None

    kept = walk(told, [by], ["_s", "_t", "_o", "_c"], ["_s", "_o", "_c"], lambda: (False, 0.0), step, "")
    return kept.select(by, F.col("_s").alias(start), F.col("_t").alias(text))


def pack(segments: DataFrame, by: str, order: str, length: str, limit: int) -> DataFrame:
    """segments with chunk: greedy packing in order, a new chunk where the limit would be passed."""
    told = segments.select(by, F.col(order).cast("bigint").alias(order), F.col(length).cast("bigint").alias("_len"))

    def step(state: tuple[int, int], row: tuple) -> tuple:
        (chunk, total), (size,) = state, row
        chunk, total = (chunk + 1, size) if total > 0 and total + size > limit else (chunk, total + size)
        return (chunk, total), (chunk,)

    return walk(told, [by], [order, "_len"], ["_len"], lambda: (0, 0), step, "chunk bigint").drop("_len")


def within_budget(rows: DataFrame, by: list[str], order: list[str], length: str, budget: int) -> DataFrame:
    """The longest prefix of each key's rows whose lengths sum to at most the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", F.sum(length).over(w)).filter(F.col("_s") <= budget).drop("_s")


def mention_index(mentions: DataFrame, kind: str, canonical: str, ts: str) -> DataFrame:
    """Per name: its distinct whole seconds, how many, and the first."""
    return mentions.groupBy(kind, canonical).agg(F.array_sort(F.collect_set(F.floor(ts).cast("bigint"))).alias("seconds")).select(kind, canonical, "seconds", F.size("seconds").alias("n"), F.element_at("seconds", 1).alias("first_second"))


def _lists(replacements: DataFrame, by: str) -> DataFrame:
    """Per key its replacements, longest original first, one per lower-case original."""
    once = replacements.groupBy(by, F.lower("original").alias("original")).agg(F.min(F.struct("official", "type")).alias("o"))
    row = F.struct((-F.length("original")).alias("len"), "original", F.col("o.official").alias("official"), F.col("o.type").alias("type"))
    return once.groupBy(by).agg(F.array_sort(F.collect_list(row)).alias("_r"))


def _quoted(c):
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def normalize_text(segments: DataFrame, replacements: DataFrame, by: str) -> DataFrame:
    """segments with normalized: originals replaced by official names, longest first, in whole words.

    A match that starts with a capital gets the official name with a capital,
    another one the official name in lower case.
    """
    end = "(?![A-Za-z0-9_])"

    def one(acc, x):
        head, tail = F.substring(x["original"], 1, 1), _quoted(F.substring(x["original"], 2, 1 << 30))
        upper = F.concat(F.lit("(?<![A-Za-z0-9_])"), _quoted(F.upper(head)), F.lit("(?i:"), tail, F.lit(")" + end))
        lower = F.concat(F.lit("(?<![A-Za-z0-9_])"), _quoted(head), F.lit("(?i:"), tail, F.lit(")" + end))
        safe = lambda c: F.regexp_replace(c, r"([\\$])", r"\\$1")
        capital = F.concat(F.upper(F.substring(x["official"], 1, 1)), F.substring(x["official"], 2, 1 << 30))
        same = F.upper(head) == head
        after = F.regexp_replace(acc, upper, safe(capital))
        return F.when(same, F.regexp_replace(acc, upper, safe(capital))).otherwise(F.regexp_replace(after, lower, safe(F.lower(x["official"]))))

    joined = segments.join(_lists(replacements, by), by, "left")
    return joined.withColumn("normalized", F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.aggregate("_r", F.col("text"), one))).drop("_r")


def tag_text(segments: DataFrame, replacements: DataFrame, by: str) -> DataFrame:
    """segments with tagged: official names and originals become [TYPE:Official], nothing inside a tag is touched."""

    def one(acc, x):
        names = F.concat(F.lit("(?i)(?<![A-Za-z0-9_])(?:"), _quoted(x["original"]), F.lit("|"), _quoted(x["official"]), F.lit(r")(?![A-Za-z0-9_])(?![^\[\]]*\])"))
        return F.regexp_replace(acc, names, F.concat(F.lit("["), F.upper(x["type"]), F.lit(":"), F.regexp_replace(x["official"], r"([\\$])", r"\\$1"), F.lit("]")))

    joined = segments.join(_lists(replacements, by), by, "left")
    return joined.withColumn("tagged", F.when(F.col("_r").isNull(), F.col("text")).otherwise(F.aggregate("_r", F.col("text"), one))).drop("_r")


def alias_variants(names: DataFrame, name: str) -> DataFrame:
    """(alias, canonical): a name in lower case, its plural or singular, and without a closing squad word."""
    low = F.lower(F.trim(name))
    variants = F.array(
        low,
        F.when(~low.endswith("s") & (F.length(low) > 5), F.concat(low, F.lit("s"))),
        F.when(low.endswith("s") & (F.length(low) > 6), F.substring(low, F.lit(1), F.length(low) - 1)),
        F.when(F.length(F.regexp_replace(low, r"\s+(?:squad|unit|team|band|pack|\[legends\])$", "")) > 5, F.regexp_replace(low, r"\s+(?:squad|unit|team|band|pack|\[legends\])$", "")),
    )
    each = names.select(F.col(name).alias("canonical"), F.explode(F.array_distinct(F.filter(variants, lambda x: x.isNotNull()))).alias("alias"))
    return each.groupBy("alias").agg(F.min("canonical").alias("canonical"))


# Seconds at which samples of a transcript start, and how long one is.
SAMPLES, SAMPLE_SECONDS = (300, 600, 900, 1200, 1500, 1800, 2400, 3000, 3600), 120


def sample_windows(segments: DataFrame, start: str, after: float) -> DataFrame:
    """segments inside the fixed sample windows that open later than ``after``."""
    hit = F.lit(False)
    for t in SAMPLES:
        if t > after:
            hit = hit | ((F.col(start) >= t) & (F.col(start) < t + SAMPLE_SECONDS))
    return segments.filter(hit)


def excerpt(segments: DataFrame, by: str, start: str, order: str, text: str, intro: float = 300, most: int = 8000) -> DataFrame:
    """(by, excerpt): the introduction, one segment a second, joined in order and cut to a number of characters."""
    once = first_per_second(segments.filter(F.col(start) < intro), [by], start, [order])
    lists = once.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(start, order, F.col(text).alias("t")))).alias("all"))
    return lists.select(by, F.left(F.array_join(F.transform("all", lambda x: x["t"]), " "), F.lit(most)).alias("excerpt"))


def pack_overlapping(segments: DataFrame, by: str, order: str, length: str, limit: int, single: int = 0) -> DataFrame:
    """(by, chunk, first, last, n) of greedy chunks in order; each but the first begins with the last segment of the one before.

    A transcript of up to ``single`` in all is one chunk. Chunks are closed
    where the next segment would pass the limit.
    """
    told = segments.select(by, F.col(order).cast("bigint").alias("_at"), F.col(length).cast("bigint").alias("_len"))
    told = told.withColumn("_total", F.sum("_len").over(Window.partitionBy(by)))

    def step(state: tuple, row: tuple) -> tuple:
        (chunk, first, before, size, held, n), (at, length_, total) = state, row
        if n > 0 and held + length_ > limit and total > single:
            chunk, first, held, n = chunk + 1, before, size, 1
        first, held, n = at if first is None else first, held + length_, n + 1
        return (chunk, first, at, length_, held, n), (chunk, first, n)

    walked = walk(told, [by], ["_at", "_len"], ["_at", "_len", "_total"], lambda: (0, None, None, 0, 0, 0), step, "chunk int, first bigint, n int")
    # A chunk is what its last row tells of it.
    return walked.groupBy(by, "chunk").agg(F.max_by(F.struct("first", F.col("_at").alias("last"), "n"), "n").alias("c")).select(by, "chunk", "c.first", "c.last", "c.n")


def text_chunks(rows: DataFrame, by: str, text: str, size: int = 8000, overlap: int = 500, single: int = 10000, back: int = 500) -> DataFrame:
    """(by, chunk, part): a text of more than ``single`` characters in chunks of about ``size``.

    A chunk ends behind the last sentence mark in its last ``back`` characters,
    else before the last space there, else where it is full; the next one
    starts ``overlap`` characters before that.
    """

    def tell(t: str) -> list[tuple[int, str]]:
        parts, at = [], 0
        while len(t) > single and at + size < len(t):
            full = at + size
            cut = max(t.rfind(mark, full - back + 1, full + 1) for mark in ".!?") + 1 or max(t.rfind(" ", full - back + 1, full + 1), -1)
            cut = cut if cut >= 0 else full
            parts.append(t[at:cut].strip(" "))
            at = cut - overlap if cut > overlap else cut
        parts.append(t[at:].strip(" "))
        return list(enumerate(p for p in parts if p))

    return each_text(rows.select(by, F.col(text).alias("_text")), [by], "_text", tell, "chunk int, part string")


def longest_spans(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (by..., start, end, ...) chosen longest first, then by start, each if it meets none chosen before."""
    rest = [c for c in spans.columns if c not in (*by, "start", "end")]
    told = spans.withColumn("_short", F.col("start") - F.col("end"))

    def step(chosen: tuple[list, list], row: tuple) -> tuple:
        """chosen: starts and ends of what has been taken, in order."""
        (starts, ends), (a, b) = chosen, row
        i = bisect_right(ends, a)
        if a < b and i < len(starts) and starts[i] < b:
            return chosen, None
        starts.insert(i, a)
        ends.insert(i, b)
        return chosen, ()

    taken = walk(told, by, ["_short", "start", "end", *rest], ["start", "end"], lambda: ([], []), step, "")
    return taken.select(*by, "start", "end", *rest)


def word_spans(segments: DataFrame, by: list[str], text: str, words: int = 3) -> DataFrame:
    """(by..., start, end, n, phrase): runs of up to ``words`` words with their places in the text, from 0."""

    def tell(t: str) -> list[tuple]:
        found = [(m[0], m.start(), m.end()) for m in _WORD.finditer(t)]
        runs = [(i, n) for i in range(len(found)) for n in range(1, min(words, len(found) - i) + 1)]
        return [(found[i][1], found[i + n - 1][2], n, " ".join(w for w, _, _ in found[i : i + n])) for i, n in runs]

    return each_text(segments.select(*by, F.col(text).alias("_text")), by, "_text", tell, "start int, end int, n int, phrase string")


def phonetic_scan(segments: DataFrame, names: DataFrame, by: list[str], text: str, name: str, common: DataFrame, least: float = 0.5, taken: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(by..., start, end, phrase, matched, confidence): runs of words that sound like a name, longest first, none over another.

    Runs of under four characters, single words of under five, common words
    (column word), runs that are a name already and runs over spans that are
    taken (by..., start, end) are left out.
    """
    from lorespark.operators.match import phonetic_pairs

    runs = word_spans(segments, by, text)
    bare = F.trim(F.regexp_replace(F.lower("phrase"), r"[^a-z\s]", ""))
    long = runs.withColumn("_bare", bare).filter((F.length("phrase") >= 4) & ((F.size(F.split("_bare", r"\s+")) > 1) | (F.length("_bare") >= 5)))
    if taken is not None:
        t = taken.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
        met = (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
        for c in by:
            met = met & (long[c] == t[c])
        long = long.join(t, met, "left_anti")
    open_ = long.join(common.select(F.col("word").alias("_bare")).distinct(), "_bare", "left_anti").drop("_bare")
    pairs = phonetic_pairs(open_.select("phrase").distinct(), names, "phrase", name, least, overrides)
    order = Window.partitionBy("phrase").orderBy(F.col("score").desc(), name)
    best = pairs.withColumn("_n", F.row_number().over(order)).filter("_n = 1").filter(F.lower("phrase") != F.lower(name))
    hits = open_.join(best.select("phrase", F.col(name).alias("matched"), F.col("score").alias("confidence")), "phrase")
    return longest_spans(hits.select(*by, "start", "end", "phrase", "matched", "confidence"), by)


def timelines(mentions: DataFrame, kind: str, canonical: str, shown: int = 5) -> DataFrame:
    """(kind, line): names by their first second, with the first few times as m:ss and the total where there are more."""
    from lorespark.functions.text import clock

    times = F.array_join(F.transform(F.slice("seconds", 1, shown), clock), ", ")
    line = F.concat(F.col(canonical), F.lit(": "), times, F.when(F.size("seconds") > shown, F.format_string("... (%d total mentions)", F.size("seconds"))).otherwise(F.lit("")))
    row = F.struct(F.col("seconds")[0].alias("first"), F.col(canonical).alias("name"), line.alias("line"))
    return mentions.filter(F.size("seconds") > 0).groupBy(kind).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["line"]), "\n").alias("lines"))


def detect_types(segments: DataFrame, dictionary: DataFrame, by: list[str], types: list[str], gated: dict[str, str] | None = None) -> DataFrame:
    """(by..., term, canonical, kind): one replacement for each distinct term of a segment, that of the first type in order.

    dictionary: term (normalised), canonical, kind. Terms of a gated type count
    only where the text holds the type's word.
    """
    from lorespark.operators.match import detect_mentions

    found = detect_mentions(segments, dictionary, by)
    for kind, word in (gated or {}).items():
        texts = segments.select(*by, F.contains(F.lower("text"), F.lit(word)).alias("_open"))
        found = found.join(texts, by).filter((F.col("kind") != kind) | F.col("_open")).drop("_open")
    rank = F.array_position(F.array(*[F.lit(k) for k in types]), F.col("kind"))
    best = found.filter(rank > 0).groupBy(*by, "term").agg(F.min_by(F.struct("canonical", "kind"), F.struct(rank, "canonical")).alias("b"))
    return best.select(*by, "term", "b.canonical", "b.kind")


def entity_spans(texts: DataFrame, names: DataFrame, by: list[str], text: str, name: str) -> DataFrame:
    """(by..., start, end, name): places (from 0) where a name, its plural, or its singular stands between marks or ends of words, longest first, none over another."""
    low = F.lower(F.trim(name))
    forms = F.array_distinct(F.filter(F.array(low, F.concat(low, F.lit("s")), F.when(F.length(low) > 3, F.regexp_replace(low, "s$", ""))), lambda x: x != ""))
    known = names.select(F.col(name).alias("name"), F.explode(forms).alias("form")).groupBy("form").agg(F.min("name").alias("name"))
    most = names.agg(F.max(F.size(F.split(F.trim(name), r"\s+")))).first()[0] or 1
    runs = word_spans(texts, by, text, most)
    head = F.regexp_extract("phrase", r"^[^\p{L}\p{N}]*", 0)
    bare = runs.withColumns({"start": F.col("start") + F.length(head), "form": F.lower(F.regexp_replace("phrase", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))}).withColumn("end", F.col("start") + F.length("form"))
    return longest_spans(bare.join(known, "form").select(*by, "start", "end", "name").distinct(), by)

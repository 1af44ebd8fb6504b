"""Quality rules with risk-controlled cutoffs.

Every document gets a few text statistics (array and string functions in the
JVM only). A rule rejects a document whose per-mille score exceeds a cutoff.
The rules are set together: a fixed sequence of steps, from lenient to strict,
gives each rule a cutoff, and a document is rejected if any rule rejects it.
Labelled good documents tell how far a stratum (language) may go: a step is
safe if the exact binomial (Clopper-Pearson) upper bound on the share of good
documents that it rejects is at most alpha. The sequence is walked until the
first step that is not safe (fixed-sequence testing, so no share of the risk
goes to single steps or rules); over the strata and the pool of all of them
the error level is divided by their number (Bonferroni). A stratum whose
labels are too few to prove even the first step, and of which the pool's step
rejects none, takes that step: its bound then holds for good documents of all
strata together, and the stratum has no bound of its own. A stratum whose
labels are enough and speak against the first step has no cutoffs. The steps
are fixed beforehand, and a
fifth of the labels is kept out of the choice: on it the realised loss is
counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, attach, documents, sized, words_of

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Risk:
    """alpha: share of good documents that may be lost per stratum, over all rules. delta: chance that any bound is wrong."""

    alpha: float = 0.02
    delta: float = 0.05


#: Per-mille scores by rule, each with its cutoffs at the steps of the sequence, from lenient to strict.
RULES = {
    "symbols": ("1000 * n_symbols", "word_chars", [500, 300, 200, 150, 100, 70, 50]),
    "dup_lines": ("1000 * n_dup_lines", "n_lines", [900, 700, 500, 400, 300, 200, 150]),
    "repeats": ("1000 * n_repeat_words", "n_words", [200, 150, 120, 100, 80, 60, 40]),
    "long_words": ("100 * word_chars", "n_words", [4000, 2500, 2000, 1600, 1400, 1200, 1100]),
}
STEPS = 7
#: One label in so many is kept out of the choice of steps.
HOLDOUT = 5


def features(docs: DataFrame) -> DataFrame:
    """docs with the base statistics and the number of lines that have a word (columns of BASE and n_lines).

    Each array is a column of its own projection, so that no lambda
    evaluates the split again for every element.
    """
    has_word = r"[^\x20\x09-\x0D]"
    text = F.coalesce(F.col("text"), F.lit(""))
    one = docs.withColumns({"_words": words_of(F.col("text")), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word))})
    two = one.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_grams": F.expr("if(size(_words) < 5, array(), transform(sequence(1, size(_words) - 4), i -> xxhash64(_words[i - 1], _words[i], _words[i + 1], _words[i + 2], _words[i + 3])))"),
        }
    )
    # Windows in hash order, then by position; only documents that repeat a window at all are sorted.
    three = two.withColumn("_sorted", F.expr("if(size(array_distinct(_grams)) = size(_grams), cast(array() as array<struct<h: bigint, i: int>>), array_sort(transform(_grams, (h, i) -> named_struct('h', h, 'i', i))))"))
    twice = "filter(_sorted, (x, k) -> (k > 0 and _sorted[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(_sorted) and _sorted[least(k + 1, size(_sorted) - 1)].h = x.h))"
    four = three.withColumn("_at", F.expr(f"array_sort(transform({twice}, x -> x.i))"))
    covered = F.expr("cast(if(size(_at) = 0, 0, 5 + aggregate(transform(_at, (p, k) -> if(k = 0, 0, least(5, p - _at[greatest(k - 1, 0)]))), 0, (a, x) -> a + x)) as bigint)")
    return four.withColumn("n_repeat_words", covered).drop("_words", "_lines", "_grams", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _over(step: str) -> str:
    """SQL: whether any rule rejects a row at a step (from 1)."""
    return "(" + " or ".join(f"{over} > element_at(array({', '.join(map(str, ladder))}), {step}) * {under}" for over, under, ladder in RULES.values()) + ")"


def held_out(doc_id: Column) -> Column:
    """Whether a label is kept for counting the realised loss."""
    return F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 4), 16, 10).cast("int") % HOLDOUT == 0


def good_ones(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """scored rows of documents labelled good that pass the base rules: the others are lost or wanted lost already."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    return scored.filter(~base_failed()).join(good, "doc_id", "left_semi")


def steps(scored: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per stratum with labels, and the pool's with a null stratum: its strictest safe step, 0 where none is; few, whether its labels
    could not prove the first step even if none were lost; lost, how many of them each step rejects.

    scored: doc_id, stratum (not null) and the statistics of features().
    labels: doc_id, quality (1: good); rows with null or other values are not used.
    """
    seen = good_ones(scored, labels).filter(~held_out(F.col("doc_id")))
    lost = [F.count_if(F.expr(_over(str(k)))).alias(f"k{k}") for k in range(1, STEPS + 1)]
    counts = Scratch(scored.sparkSession, "quality_counts").write(seen.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *lost), "counts")
    tests = counts.count() + 1
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *[f"k{k}" for k in range(1, STEPS + 1)]]]
    both = counts.unionByName(counts.agg(F.lit(None).cast("string").alias("stratum"), *sums))
    each = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"k{k}").alias("k")) for k in range(1, STEPS + 1)])
    tested = both.select("stratum", "n", F.explode(each).alias("x")).select("stratum", "n", "x.*")
    # P(Bin(n, a) <= k) <= level  <=>  the Clopper-Pearson upper bound for k of n is at most a.
    a = risk.alpha
    tail = f"""aggregate(sequence(1L, greatest(k, 1L)), named_struct('t', n * ln(1 - {a!r}D), 's', exp(n * ln(1 - {a!r}D))),
        (acc, i) -> if(i > k, acc, named_struct('t', acc.t + ln((n - i + 1) / cast(i as double)) + ln({a!r}D / (1 - {a!r}D)),
                                                's', acc.s + exp(acc.t + ln((n - i + 1) / cast(i as double)) + ln({a!r}D / (1 - {a!r}D))))), acc -> acc.s)"""
    bound = tested.withColumn("safe", F.expr(f"if(k > n * {a!r}D, false, {tail} <= {risk.delta!r}D / {tests})"))
    few = F.expr(f"exp(n * ln(1 - {a!r}D)) > {risk.delta!r}D / {tests}")
    lost = F.transform(F.array_sort(F.collect_list(F.struct("step", "k"))), lambda x: x["k"])
    return bound.groupBy("stratum").agg((F.coalesce(F.min(F.when(~F.col("safe"), F.col("step"))), F.lit(STEPS + 1)) - 1).alias("step"), F.first(few).alias("few"), lost.alias("lost"))


def _applied(chosen: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The strata's own steps, and columns for the step that a row takes and for where it comes from, once they are attached.

    The pool's step goes to strata with no labels, and to those with too few of which it loses none.
    """
    pool = chosen.filter("stratum is null").first()["step"]
    pooled = F.col("few") & (F.element_at("lost", F.lit(max(pool, 1))) == 0)
    has_own, takes_pool = F.coalesce("own", F.lit(0)) > 0, F.coalesce("pooled", F.lit(True)) & F.lit(pool > 0)
    step = F.when(has_own, F.col("own")).when(takes_pool, F.lit(pool)).otherwise(F.lit(0))
    source = F.when(has_own, "own").when(takes_pool, "pool").otherwise("none")
    return chosen.filter("stratum is not null").select("stratum", F.col("step").alias("own"), pooled.alias("pooled")), step, source


def rejected() -> Column:
    """Whether a rule rejects a row at its step."""
    return (F.col("step") > 0) & F.expr(_over("greatest(step, 1)"))


def verdict(scored: DataFrame, chosen: DataFrame) -> DataFrame:
    """scored with base_failed, kept, step (0: no cutoffs) and its source (own, pool, none)."""
    own, step, source = _applied(chosen)
    ruled = attach(scored, own, ["stratum"], "doc_id").withColumns({"step": step, "source": source}).drop("own", "pooled")
    return ruled.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected())


def realised_loss(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """Per stratum of verdict()'s rows: labelled good documents that no step was chosen by, and how many of them are lost."""
    kept_apart = good_ones(judged, labels).filter(held_out(F.col("doc_id")))
    return kept_apart.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_holdout"), F.count_if(~F.col("kept")).alias("n_holdout_lost"))


def stratum_of(docs: DataFrame) -> Column:
    """Documents without a language form a stratum of their own."""
    return F.coalesce(F.col("lang"), F.lit("?")) if "lang" in docs.columns else F.lit("?")


def quality_report(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """One row per document: doc_id, the base statistics, base_failed, kept, stratum, step, source, and of its stratum n_holdout and n_holdout_lost.

    A null text counts as empty and fails the base rules; a null language is a
    stratum of its own; a null doc_id has no label. Texts are judged whole,
    whatever their length. Repeated rows are judged one by one. Other columns
    of docs are not looked at, whatever their names. Empty docs give an empty
    result; empty labels give no cutoffs, so that only the base rules reject.
    """
    slim = docs.select("doc_id", "text", stratum_of(docs).alias("stratum"))
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.write(features(slim).drop("text"), "features")
    judged = verdict(scored, scratch.write(steps(scored, labels, risk), "steps"))
    loss = attach(judged, scratch.write(realised_loss(judged, labels), "loss"), ["stratum"], "doc_id")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return loss.select("doc_id", *BASE, "base_failed", "kept", "stratum", F.col("step").cast("int").alias("step"), "source", zero("n_holdout"), zero("n_holdout_lost"))


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that the rules keep, with their columns unchanged, whatever their names; cases as in quality_report().

    The statistics are computed beside the text, so no text is shuffled: for
    the labelled good documents to find the steps, then for all to filter.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    scratch = Scratch(docs.sparkSession, "quality")
    slim = docs.select("doc_id", "text", stratum_of(docs).alias("stratum")).join(sized(good), "doc_id", "left_semi")
    scored = scratch.write(features(slim).drop("text"), "features")
    own, step, _ = _applied(scratch.write(steps(scored, labels, risk), "steps"))
    # The base limits come from the joined side as well: a filter that needs only the statistics would be
    # pushed below them, and their array expressions evaluated again for every element.
    limits = own.withColumns({"_least": F.lit(10), "_most": F.lit(20)})
    hidden = docs.select("doc_id", "text", stratum_of(docs).alias("stratum"), *[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(docs.columns)])
    ruled = attach(features(hidden), limits, ["stratum"], "doc_id").withColumn("step", step)
    failed = (F.col("n_words") < F.coalesce("_least", F.lit(10))) | (100 * F.col("n_repeat_words") > F.coalesce("_most", F.lit(20)) * F.col("n_words"))
    # coalesce keeps Spark from inferring "is not null" filters on the statistics and pushing those down.
    return ruled.filter(F.coalesce(~(failed | rejected()), F.lit(False))).select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    a, level = Risk().alpha, Risk().delta
    over = lambda k: "(" + " OR ".join(f"{x} > {ladder[k]} * {y}" for x, y, ladder in RULES.values()) + ")"
    tests = "\nUNION ALL\n".join(f"SELECT stratum, {k + 1} AS step, count(*) AS n, count(*) FILTER (WHERE {over(k)}) AS k FROM cal GROUP BY stratum" for k in range(STEPS))
    lost = " ".join(f"WHEN {k + 1} THEN {over(k)}" for k in range(STEPS))
    return rf"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '?') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w),
gram AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM g),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM gram),
spots AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice WHERE c > 1),
rep AS (SELECT doc_id, sum(CASE WHEN nxt IS NULL THEN 5 ELSE least(5, nxt - i) END)::BIGINT AS r FROM spots GROUP BY doc_id),
f AS (
  SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, ('0x' || md5(doc_id::VARCHAR)[1:4])::INT % {HOLDOUT} = 0 AS apart FROM f),
good AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cal AS (SELECT * FROM good WHERE NOT apart UNION ALL SELECT * REPLACE (NULL AS stratum) FROM good WHERE NOT apart),
tests AS ({tests}),
judged AS (
  SELECT *, CASE WHEN k > n * {a!r} THEN false ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a!r}) + (n - i) * ln(1 - {a!r}))))
      <= {level!r} / (SELECT count(DISTINCT stratum) + 1 FROM tests) END AS safe
  FROM tests),
own AS (
  SELECT stratum, (coalesce(min(CASE WHEN NOT safe THEN step END), {STEPS + 1}) - 1)::INT AS step,
         any_value(exp(n * ln(1 - {a!r})) > {level!r} / (SELECT count(DISTINCT stratum) + 1 FROM tests)) AS few
  FROM judged GROUP BY stratum),
pool AS (SELECT coalesce(max(step), 0) AS p FROM own WHERE stratum IS NULL),
open AS (
  SELECT own.stratum, own.step, few AND NOT EXISTS (SELECT 1 FROM tests WHERE tests.stratum = own.stratum AND tests.step = greatest(p, 1) AND k > 0) AS pooled
  FROM own CROSS JOIN pool WHERE own.stratum IS NOT NULL),
v AS (
  SELECT b.*, CASE WHEN coalesce(open.step, 0) > 0 THEN open.step WHEN coalesce(pooled, true) THEN p ELSE 0 END AS step,
         CASE WHEN coalesce(open.step, 0) > 0 THEN 'own' WHEN coalesce(pooled, true) AND p > 0 THEN 'pool' ELSE 'none' END AS source
  FROM b CROSS JOIN pool LEFT JOIN open ON b.stratum = open.stratum),
k AS (SELECT *, NOT base_failed AND NOT (CASE step {lost} ELSE false END) AS kept FROM v),
h AS (SELECT stratum, count(*) AS n_holdout, count(*) FILTER (WHERE NOT kept) AS n_holdout_lost FROM k
      WHERE apart AND NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, k.stratum, step::INT AS step, source,
       coalesce(n_holdout, 0) AS n_holdout, coalesce(n_holdout_lost, 0) AS n_holdout_lost
FROM k LEFT JOIN h ON k.stratum = h.stratum
"""


OP7_SQL = _sql()

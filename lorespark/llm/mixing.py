"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target bytes over
its own bytes. A document's number of copies is the Poisson variable with that
mean, found by inverting its distribution at a uniform number hashed from seed
and doc_id; so the mix is the same on any cluster and any re-run. Copies are
exploded and dealt over all partitions by a hash of their own, and sorted by
it within each: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import attach, documents

SEED = 20
#: Weights where none are given: a source weighs its bytes to this power.
POWER = 0.5
#: A larger mean is the sum of equal parts up to this one, each drawn by itself: exp(-rate) stays far from underflow.
LARGEST = 500.0
#: Bytes of the mix, as a multiple of the bytes of the corpus.
EPOCHS = 1.0


def _uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 48 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS) -> DataFrame:
    """One row per source: source, bytes and rate (mean copies per document).

    weights: source, weight (relative, not negative). A source that it does
    not name gets rate 0; a source without bytes too.
    """
    sizes = docs.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("bigint").alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(POWER)))
    else:
        weighed = sizes.join(weights.groupBy("source").agg(F.sum("weight").cast("double").alias("weight")), "source", "left").fillna(0.0, ["weight"])
    total = weighed.agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.coalesce(F.try_divide(F.lit(epochs) * F.col("all_bytes") * F.col("weight"), F.col("all_weight") * F.col("bytes")), F.lit(0.0))
    return weighed.crossJoin(F.broadcast(total)).select("source", "bytes", rate.alias("rate"))


def _cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as far as doubles tell them from 1."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / k).alias("p"),
        (acc["c"] + acc["p"] * rate / k).alias("c"),
        F.concat(acc["all"], F.array(acc["c"] + acc["p"] * rate / k)).alias("all"),
    )
    first = F.exp(-rate)
    return F.aggregate(F.sequence(F.lit(1), top), F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")), step, lambda acc: acc["all"])


#: Rows without a doc_id are dealt over so many keys more, for they may share one text.
SPREAD = 1024
NEW = ["copy", "copies", "shuffle_key"]


def _mixed(docs: DataFrame, weights: DataFrame | None, epochs: float, seed: int) -> DataFrame:
    """The columns of docs by position (c0, c1, ...), and those of NEW."""
    table = rates(docs, weights, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST), F.lit(1)).cast("int")
    cdfs = table.select(F.col("source").alias("_source"), parts.alias("_parts"), _cdf(F.col("rate") / parts).alias("_cdf"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    deal = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD))).otherwise(0)
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    drawn = docs.select(*columns, F.coalesce("source", F.lit("?")).alias("_source"), key.alias("_key"), deal.alias("_deal"))
    met = attach(drawn, cdfs, ["_source"], "_key", "inner")
    # The first part's uniform is hashed from seed and doc_id alone, those of further parts from their number too.
    uniforms = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: _uniform(F.lit(str(seed)), F.col("_key"), F.when(j > 0, j.cast("string"))))
    counted = met.withColumn("_us", uniforms).withColumn("copies", F.expr("aggregate(_us, 0, (n, u) -> n + size(filter(_cdf, c -> c <= u)))"))
    copies = counted.filter("copies > 0").drop("_source", "_us", "_parts", "_cdf").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)")))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shuffle"), F.col("_key"), F.col("copy"))))
    return keyed.repartition("shuffle_key", "_deal").sortWithinPartitions("shuffle_key").drop("_key", "_deal")


def mix(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: docs' columns, and copy (from 0), copies and shuffle_key.

    A null source is a source of its own; a null or empty text has no bytes,
    but is drawn like the others of its source; texts of any length go whole.
    Rows that repeat a doc_id share its draw; a null doc_id is drawn by its
    text. Columns of docs named like the three new ones are replaced (mix_rows
    keeps them); any other names stay. Empty docs give an empty mix. A rate
    above LARGEST is drawn as the sum of equal parts, so none underflows.
    """
    out = _mixed(docs, weights, epochs, seed)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in NEW], *NEW)


def mix_rows(docs: DataFrame, weights: DataFrame | None = None, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """mix() with docs' columns alone, whatever their names."""
    return _mixed(docs, weights, epochs, seed).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP5_SQL = f"""
WITH s AS (SELECT coalesce(source, '?') AS source, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents GROUP BY 1),
r AS (SELECT source, {EPOCHS!r} * sum(bytes) OVER () * pow(bytes, {POWER}) / (sum(pow(bytes, {POWER})) OVER () * bytes) AS rate FROM s WHERE bytes > 0),
c AS (SELECT source, list_transform(range(0, 100), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1))))) AS cdf FROM r),
d AS (
  SELECT doc_id, text, lang, documents.source, n_chars,
         ('0x' || md5('{SEED}:' || doc_id)[1:12])::BIGINT / {float(2**48)!r} AS u, cdf
  FROM documents JOIN c ON coalesce(documents.source, '?') = c.source),
n AS (SELECT *, len(list_filter(cdf, lambda x: x <= u))::INT AS copies FROM d),
e AS (SELECT *, unnest(range(0, copies))::INT AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copy, copies, md5('{SEED}:shuffle:' || doc_id || ':' || copy) AS shuffle_key FROM e
"""

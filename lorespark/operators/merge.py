"""Putting partial results together: dictionaries by precedence, scoped mappings, chunk results, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.etl import latest


def categorize(terms: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """The kind of each distinct term: of the dictionary entries (name, kind, precedence) equal to it in lower case,
    the one of lowest precedence; unknown without any."""
    best = dictionary.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.min_by(F.struct("name", "kind"), F.struct("precedence", "name")).alias("b"))
    t = terms.select(term).distinct()
    return t.join(best, F.lower(F.trim(term)) == F.col("_k"), "left").select(term, F.coalesce("b.kind", F.lit("unknown")).alias("kind"), F.col("b.name").alias("canonical"))


def scoped_mapping(queries: DataFrame, mappings: DataFrame, by: list[str], scope: str, value: str) -> DataFrame:
    """queries with the value mapped in their own scope, or else in the general one (null scope)."""
    m = mappings.select(*by, F.col(scope).alias("_s"), value)
    met = queries.select(*by, scope).distinct().join(m, by, "left").filter(F.col("_s").isNull() | (F.col("_s") == F.col(scope)))
    own = F.struct(F.col("_s").isNotNull(), value)
    best = met.groupBy(*by, scope).agg(F.max_by(value, F.when(F.col(value).isNotNull(), own)).alias(value))
    return queries.select(*by, scope).distinct().join(best, [*by, scope], "left")


def merge_units(chunks: DataFrame) -> DataFrame:
    """chunks: report, chunk, name, player, confidence. One row per report, lower-case name and player, the surest; then of the first chunk."""
    rank = F.expr("case confidence when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end")
    low = chunks.withColumn("_low", F.lower("name"))
    return latest(low, ["report", "_low", "player"], [rank.desc(), "chunk"]).drop("_low")


def merge_scalars(chunks: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Per report the first value in chunk order that is not null, for each column."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return chunks.groupBy(by).agg(*first)


def suggestions(found: list[DataFrame], term: str, name: str, k: int = 5) -> DataFrame:
    """The k best names of each term over several matchers' pairs (term, name, score), each at its best score."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    best = out.groupBy(term, name).agg(F.max("score").alias("score"))
    order = Window.partitionBy(term).orderBy(F.col("score").desc(), name)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

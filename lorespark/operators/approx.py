"""Approximate search of short patterns in the fields of a catalogue, wherever in a field they stand.

The score of a field is the share of the pattern's characters that must be
edited for it to occur in the field. Candidates come from the pigeonhole
principle: a pattern cut into one part more than there are edits allowed has a
part that occurs unchanged. Pairs are then measured by bit-parallel edit
distance, a batch of pairs at a time: each pair's column of the distance matrix
is one 64-bit word, and all pairs take a character of their texts per step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# A pattern's longest piece, the worst score of a hit, the score of a piece that occurs unchanged, and the shortest run of the pattern's characters that a field must hold.
PIECE, WORST, FOUND, RUN = 32, 0.4, 0.001, 3


def edits(patterns: list[str], texts: list[str]) -> np.ndarray:
    """For each pair the fewest edits that turn some part of the text into the pattern (1 to 64 characters)."""
    n, sizes = len(patterns), np.array([len(p) for p in patterns], np.int64)
    best = sizes.copy()
    if not n:
        return best
    letters = {c: i for i, c in enumerate(sorted(set("".join(patterns))), 1)}
    masks = np.zeros((n, len(letters) + 1), np.uint64)
    for i, p in enumerate(patterns):
        for k, c in enumerate(p):
            masks[i, letters[c]] |= np.uint64(1 << k)
    # Texts as numbers of letters, 0 for those of no pattern; short ones end in zeros, at which no distance falls.
    longest = max(map(len, texts))
    text = np.zeros((n, longest), np.int32)
    for i, t in enumerate(texts):
        text[i, : len(t)] = [letters.get(c, 0) for c in t]
    ones, rows = np.uint64(0xFFFFFFFFFFFFFFFF), np.arange(n)
    last = np.uint64(1) << (sizes - 1).astype(np.uint64)
    plus, minus, score = np.full(n, ones), np.zeros(n, np.uint64), sizes.copy()
    one = np.uint64(1)
    for j in range(longest):
        same = masks[rows, text[:, j]]
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus), plus & across
        score += ((up & last) != 0).astype(np.int64) - ((down & last) != 0)
        np.minimum(best, score, out=best)
        up, down = up << one, down << one
        plus, minus = down | ~(vertical | up), up & vertical
    return best


def pieces(pattern: Column) -> Column:
    """A pattern in pieces of PIECE characters; the last one is taken from its end, so it may overlap the one before."""
    n = F.length(pattern)
    starts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / PIECE).cast("int")), lambda i: F.least(i * PIECE, F.greatest(n - PIECE, F.lit(0))))
    return F.transform(starts, lambda s: F.substring(pattern, s + 1, F.lit(PIECE)))


def parts(piece: Column, worst: float = WORST) -> Column:
    """A piece cut into one part more than the edits that the worst score allows."""
    n = F.length(piece)
    k = F.floor(n * worst + 1e-9).cast("int") + 1
    cut = lambda i: F.floor(i * n / k).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring(piece, cut(i) + 1, cut(i + 1) - cut(i))))


def _grams(text: Column, longest: int) -> Column:
    """All distinct runs of 1 to ``longest`` characters."""
    of = lambda size: F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, longest + 1)])))


def field_norm(text: Column) -> Column:
    """What a field's score counts for: one over the root of its number of words, to three places."""
    return F.round(1 / F.sqrt(F.greatest(F.size(F.regexp_extract_all(text, F.lit("[^ ]+"), 0)), F.lit(1)).cast("double")), 3)


@F.pandas_udf(LongType())
def edits_of(patterns: pd.Series, texts: pd.Series) -> pd.Series:
    """edits() of pairs of columns."""
    return pd.Series(edits(patterns.tolist(), texts.tolist()))


def _has_run(pattern: Column, text: Column) -> Column:
    """Whether RUN characters in a row of the text occur in the pattern."""
    quoted = F.regexp_replace(pattern, r"([\\\[\]^&-])", r"\\$1")
    return F.regexp_count(text, F.concat(F.lit("["), quoted, F.lit(f"]{{{RUN}}}"))) > 0


def approximate_search(queries: DataFrame, items: DataFrame, query: str, fields: dict[str, float], scope: list[str] = (), worst: float = WORST) -> DataFrame:
    """(scope..., query, columns of items, score): every item of a query's scope with a field in which the query occurs with few enough edits.

    fields: columns of items (strings) with their weights. A field that equals
    the query but for case scores next to nothing, one that holds it as a part
    FOUND, else the share of its characters to edit, of the pieces of a long
    query on average; a piece with more than ``worst`` of it counts 1, and at
    least one piece must be found. Fields without RUN characters in a row of
    the query's do not count. An item's score is the product of its fields'
    scores, each to the power of its weight and of field_norm(). Null and empty
    queries and fields meet nothing; repeated rows count once.
    """
    q = queries.select(*scope, query).filter(F.length(query) > 0).distinct()
    rows = items.distinct().withColumn("_item", F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in items.columns]))))
    total = sum(fields.values())
    low_q = F.lower(query)
    asked = q.withColumn("_p", low_q).withColumn("_piece", F.explode(F.array_distinct(pieces(F.col("_p")))))
    probe = asked.select(*scope, query, "_p", "_piece", F.explode(parts(F.col("_piece"), worst)).alias("_g"))
    longest = -(-PIECE // (int(PIECE * worst + 1e-9) + 1)) + 1
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lower(c).alias("text"), F.lit(w / total).alias("weight")) for c, w in fields.items()]))
    told = rows.select(*scope, "_item", each.alias("f")).select(*scope, "_item", "f.*").filter(F.length("text") > 0)
    # Fields that are equal in a scope are measured once.
    texts = told.select(*scope, "text").distinct()
    met = probe.join(texts.withColumn("_g", F.explode(_grams(F.col("text"), longest))), [*scope, "_g"]).select(*scope, query, "_p", "_piece", "text").distinct()
    measured = met.withColumn("_e", edits_of("_piece", "text")).withColumn("_s", F.col("_e") / F.length("_piece")).filter(F.col("_s") <= worst)
    n_pieces = F.size(pieces(F.col("_p")))
    # Pieces that repeat in a pattern count as often as they occur in it.
    times = F.size(F.filter(pieces(F.col("_p")), lambda x: x == F.col("_piece")))
    found = measured.groupBy(*scope, query, "_p", "text").agg(F.sum(F.greatest(F.col("_s"), F.lit(FOUND)) * times).alias("_sum"), F.sum(times).alias("_n"))
    score = F.when(F.col("_p") == F.col("text"), F.lit(2.0**-52)).otherwise((F.col("_sum") + n_pieces - F.col("_n")) / n_pieces)
    good = found.withColumn("_score", score).filter((F.col("_p") == F.col("text")) | _has_run(F.col("_p"), F.col("text")))
    powers = told.join(good, [*scope, "text"]).groupBy(*scope, query, "_item").agg(F.exp(F.sum(F.col("weight") * field_norm(F.col("text")) * F.log("_score"))).alias("score"))
    return powers.join(rows, [*scope, "_item"]).drop("_item")


def best_of(hits: DataFrame, by: list[str], name: str, k: int) -> DataFrame:
    """hits with rank: the k lowest scores of each query, ties by name."""
    order = Window.partitionBy(*by).orderBy("score", name)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

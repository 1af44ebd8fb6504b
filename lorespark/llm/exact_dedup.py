"""Exact dedup: tree-merge of sorted digest runs.

Each input partition makes one run: its distinct digests, each with the best
row that the run has seen. The rounds are those of a binomial tree, three of
its steps at a time: after k rounds run r holds what the runs r * FAN^k to
(r + 1) * FAN^k - 1 held, FAN = 2^3, so a round is one exchange and an
eight-way merge in place of three exchanges of pairs, with the same result.
Rows meet by (merged run, digest), Spark sorts and merges them, and each
digest keeps its best row. A digest thus meets at most FAN rows in a task,
even where a third of all rows are copies of one text. After the last round
one run is left, spread over all tasks by digest. The winners then go back
down the same tree, one round at a time, so the way back has no hot key either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, documents, keep_rows, row_id, row_mark, without_spaces

#: Runs merged into one in a round.
FAN = 8

#: What must agree for two rows to count as copies: the digest, and the length and a second hash that verify it at each level.
SAME = ["text_sha256", "norm_chars", "norm_hash"]


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, length, digest of the normalised text, the run (partition) that it is in, and row_id and row_mark."""
    keys = [row_id(F.col("doc_id")).alias("_oid"), row_mark(F.col("text")).alias("_mark")]
    norm = docs.select("doc_id", *keys, F.length(F.coalesce("text", F.lit(""))).alias("chars"), without_spaces(F.col("text")).alias("norm"))
    return norm.select(
        "doc_id",
        "chars",
        F.sha2("norm", 256).alias("text_sha256"),
        F.length("norm").alias("norm_chars"),
        F.xxhash64("norm").alias("norm_hash"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row_no"),
        "_oid",
        "_mark",
    )


def _best() -> list:
    """Most code points, then smallest doc_id (null last), then first row. Structs compare field by field."""
    rank = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    return [rank.alias("rank"), F.lit(1).cast("bigint").alias("n")]


def tree_merge(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """Leaves (a written table of digests()) with keep_id, keep_row and group_size of their group."""
    top = leaves.agg(F.max("run")).first()[0] or 0
    levels = [leaves.select("run", *SAME, *_best()).groupBy("run", *SAME).agg(F.min("rank").alias("rank"), F.sum("n").alias("n"))]
    levels[0] = scratch.write(levels[0], "run0")
    while top > 0:
        top //= FAN
        up = levels[-1].withColumn("run", F.floor(F.col("run") / FAN).cast("int")).groupBy("run", *SAME)
        levels.append(scratch.write(up.agg(F.min("rank").alias("rank"), F.sum("n").alias("n")), f"run{len(levels)}"))
    won = levels[-1]
    for below in reversed(levels[:-1]):
        parent = F.floor(F.col("run") / FAN).cast("int").alias("up")
        found = won.withColumnRenamed("run", "up")
        won = below.select("run", parent, *SAME).join(found, ["up", *SAME]).drop("up")
    won = won.select("run", *SAME, F.col("rank.doc_id").alias("keep_id"), F.col("rank.row_no").alias("keep_row"), F.col("n").alias("group_size"))
    return leaves.join(won, ["run", *SAME])


def _judged(docs: DataFrame, scratch: Scratch) -> DataFrame:
    leaves = scratch.write(digests(docs), "leaves")
    return tree_merge(leaves, scratch).withColumn("kept", F.col("row_no") == F.col("keep_row"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document with the row of its group that stays.

    Input: doc_id, text, any other columns. Texts are equal when identical
    after deleting ``[\\x20\\x09-\\x0D]``; a null text counts as empty; texts are
    digested whole, whatever their length. The row with the most code points
    stays, then the smallest doc_id (null last); of fully repeated rows exactly
    one has kept = true. Other columns are not looked at, whatever their names.
    Empty input gives an empty result.
    """
    return _judged(docs, Scratch(docs.sparkSession, "exact_dedup")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents whose rows stay, with their columns unchanged, whatever their names; groups as in exact_dedup().

    Rows that repeat wholly (same doc_id, same text) leave one row, any of
    them. Empty input gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "exact_dropped")
    judged = scratch.write(_judged(docs, scratch).select("_oid", "_mark", "kept", F.lit(True).alias("once")), "judged")
    return keep_rows(docs, judged, scratch)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""

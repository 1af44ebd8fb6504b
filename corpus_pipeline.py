"""A training corpus from documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything
that the stage before it kept; its result is written as Parquet and read again
as the next one's docs, which also cuts the lineage.

Every stage takes any columns beside those of documents, whatever their names,
and all but the last hand them on unchanged. Null and empty texts fail the
quality rules; where a stage is used by itself, each counts as an empty text.
A null doc_id is a row like any other: deduplication tells rows apart by
doc_id and text. Texts of any length are read whole. Of rows that repeat
wholly, exact dedup leaves one. Empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.llm.bpe import encode_digests, tokenizer_path
from lorespark.llm.common import Scratch, documents
from lorespark.llm.exact_dedup import drop_copies
from lorespark.llm.mixing import mix_rows
from lorespark.llm.near_dedup import drop_near_copies
from lorespark.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return drop_near_copies(docs, shingle_words=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus at its target weights: sources by the square root of their bytes, copies as rows of their own."""
    return mix_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every row: counts, and digests of the ids and of the text decoded from them."""
    return encode_digests(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("bpe", encoded)]

#: Near-duplicate groups are a closure over similarity, which SQL does not express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Shared pieces of the corpus operators: shared-folder tables, checked small-side joins, word arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.scratch import Scratch, shared_folder  # noqa: F401

#: The six ASCII white-space characters that separate words, and the word pattern itself.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only when its counted rows and its measured bytes are at most these.
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20
#: Copies of the other side of a join whose key may be hot, when it is too large to broadcast.
SALTS = 16


def fits(side: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether a side of a join is small enough to broadcast: its rows are counted and its values measured, in one pass."""
    sized = {"string": F.octet_length, "binary": F.octet_length}
    wide = lambda c, kind: sized[kind](F.col(f"`{c}`")) if kind in sized else F.octet_length(F.to_json(F.struct(f"`{c}`"))) if "<" in kind else F.lit(8)
    width = sum((F.coalesce(wide(c, kind), F.lit(0)) for c, kind in side.dtypes), F.lit(16))
    n, size = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and size <= SMALL_BYTES


def sized(side: DataFrame) -> DataFrame:
    """The side, marked for broadcast if it fits."""
    return F.broadcast(side) if fits(side) else side


def attach(df: DataFrame, small: DataFrame, on: list[str], spread: str, how: str = "left", rows: int = SMALL_ROWS) -> DataFrame:
    """Join df to another side, whatever its size and however hot a key of df is.

    The side is measured first: if it fits it is broadcast; otherwise it is
    copied SALTS times and df's rows are spread over the copies by a hash of
    column ``spread``, so a key with a third of df's rows meets SALTS tasks
    instead of one.
    """
    if fits(small, rows):
        return df.join(F.broadcast(small), on, how)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


NO_ID = (1 << 63) - 1


def row_id(doc_id: Column) -> Column:
    """The doc_id, or, for null, a number that counts as larger than any other."""
    return F.coalesce(doc_id, F.lit(NO_ID))


def row_mark(text: Column) -> Column:
    """MD5 of the text as it stands: with the doc_id it tells rows apart, whatever ids are null or repeat."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def keep_rows(docs: DataFrame, judged: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs that stay, with their columns unchanged, whatever their names.

    judged: _oid and _mark (row_id and row_mark) of every row, kept, and once
    (whether only one of the rows that repeat doc_id and text stays). Rows that
    go are few as a rule; they are taken out by an anti-join, which shuffles no
    text while they fit a broadcast.
    """
    keys = judged.groupBy("_oid", "_mark").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"), F.max("once").alias("once"))
    keys = scratch.write(keys.filter("not kept or (once and n > 1)"), "verdicts")
    gone, twice = keys.filter("not kept").select("_oid", "_mark"), keys.filter("kept").select("_oid", "_mark")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_id(F.col("doc_id")).alias("_oid"), row_mark(F.col("text")).alias("_mark"))
    stay = keyed.join(sized(gone), ["_oid", "_mark"], "left_anti")
    if not twice.isEmpty():
        once = stay.join(sized(twice), ["_oid", "_mark"], "left_semi").groupBy("_oid", "_mark").agg(F.first("_row").alias("_row"))
        stay = stay.join(sized(twice), ["_oid", "_mark"], "left_anti").select("_row").union(once.select("_row"))
    return stay.select("_row.*")


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null and for texts without a word."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def without_spaces(text: Column) -> Column:
    """The text (null: empty) with every ASCII white-space character deleted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal keys from batches that are sorted by those keys.

    At most one unfinished group is held over from a batch to the next.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            if held:
                last = held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py()
                change[0] |= last != v[0]
        at = np.flatnonzero(change).tolist()
        begin = 0
        for i in at:
            if i > begin:
                held.append(batch.slice(begin, i - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], i
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)

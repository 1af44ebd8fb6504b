"""Tables kept up to date by a stream, a batch at a time.

A table is a folder of Parquet files in buckets of its key. A batch rewrites
only the buckets that its rows fall into: their new rows are written beside the
table first and then take the buckets' place by dynamic partition overwrite.
Each kind of write gives the same table when a batch comes again, and the
number of the last batch is kept, so that one that is through is not repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators.etl import latest
from lorespark.scratch import Scratch

BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table; none where nothing has been written."""
    return spark.read.schema(f"{schema}, _bucket int").parquet(f"{path}/rows").drop("_bucket") if _exists(spark, f"{path}/rows") else spark.createDataFrame([], schema)


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch that is through, -1 before the first."""
    if not _exists(spark, f"{path}/batches"):
        return -1
    n = spark.read.schema("batch bigint").parquet(f"{path}/batches").agg(F.max("batch")).first()[0]
    return -1 if n is None else n


def merge_into(batch: DataFrame, path: str, key: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Give the buckets of a table that a batch's keys fall into their new rows: merged(old rows, batch's rows)."""
    spark = batch.sparkSession
    scratch = Scratch(spark, "merge")
    told = scratch.write(batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), "batch")
    # At most ``buckets`` numbers.
    touched = [r["_bucket"] for r in told.select("_bucket").distinct().collect()]
    if not touched:
        return
    schema = ", ".join(f"`{c}` {t}" for c, t in batch.dtypes)
    old = spark.read.schema(f"{schema}, _bucket int").parquet(f"{path}/rows").filter(F.col("_bucket").isin(touched)) if _exists(spark, f"{path}/rows") else told.limit(0)
    new = merged(old.drop("_bucket"), told.drop("_bucket")).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    # Written beside the table: the buckets are read while their new rows are made.
    ready = scratch.write(new, "new")
    ready.repartition(min(buckets, len(touched)), "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{path}/rows")


def upserted(key: list[str], order: list) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of the rows of a key, old and new, the first in order stays; the order must tell all different rows of a key apart."""
    return lambda old, new: latest(old.unionByName(new), key, order)


def inserted(key: list[str], order: list) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows whose key is there already are left out; of a batch's rows of a key the first in order comes in."""
    return lambda old, new: old.unionByName(latest(new, key, order).join(old.select(*key), key, "left_anti"))


def replaced(parent: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """All rows of a parent that the batch has rows of give way to these; the table's key is the parent."""
    return lambda old, new: old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def table_sink(path: str, key: list[str], merged: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: batches up to the last one that is through are passed over, others merged into the table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= last_batch(spark, path):
            return
        merge_into(batch, path, key, merged, buckets)
        spark.range(number, number + 1).select(F.col("id").alias("batch")).coalesce(1).write.mode("append").parquet(f"{path}/batches")

    return write

"""Joins on time, ranges, tiers and fallbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, take: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with columns of the latest right row of the same key at or before its time; nulls where there is none.

    One shuffle: both sides go into one ordered stream per key, right rows
    first at equal times, and the last right row is carried forward. Where a
    key may hold a large part of all rows, bucket (a function of the time that
    never falls as it grows) parts its stream: each bucket is a stream of its
    own, and the last right row of the buckets before is carried in from a
    table of one row per key and bucket.
    """
    kind = right.select(F.struct(ts, *take)).schema[0].dataType
    part = (lambda df: df.withColumn("_bucket", bucket(F.col(ts)))) if bucket else (lambda df: df.withColumn("_bucket", F.lit(0)))
    l = part(left).withColumns({"_side": F.lit(1), "_r": F.lit(None).cast(kind)})  # noqa: E741
    r = part(right).select(by, ts, "_bucket", F.lit(0).alias("_side"), F.struct(ts, *take).alias("_r"))
    both = l.unionByName(r, allowMissingColumns=True)
    keys = [by, "_bucket"] if bucket else [by]
    order = Window.partitionBy(*keys).orderBy(F.col(ts), F.col("_side"), *[F.col(f"_r.{c}") for c in take]).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_r", ignorenulls=True).over(order)).filter("_side = 1")
    if bucket:
        ends = both.groupBy(by, "_bucket").agg(F.max("_r").alias("_end"))
        before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(by, "_bucket", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        seen = seen.join(carried, [by, "_bucket"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return seen.select(*left.columns, F.col(f"_last.{ts}").alias(f"{ts}_then"), *[F.col(f"_last.{c}").alias(c) for c in take])


def band(left: DataFrame, right: DataFrame, by: str, ts: str, seconds: int, prefix: str = "r_") -> DataFrame:
    """Pairs of one key whose times differ by at most so many seconds; buckets of that width make it an equi-join."""
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(seconds * 1_000_000))
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn("_b", bucket(F.col(prefix + ts)))
    l = left.withColumn("_b", F.explode(F.sequence(bucket(F.col(ts)) - 1, bucket(F.col(ts)) + 1)))  # noqa: E741
    near = F.abs(F.unix_micros(ts) - F.unix_micros(prefix + ts)) <= seconds * 1_000_000
    return l.join(r, (l[by] == r[prefix + by]) & (l["_b"] == r["_b"]) & near).drop("_b")


def into_intervals(points: DataFrame, starts: DataFrame, by: list[str], at: str, start: str, take: list[str]) -> DataFrame:
    """points with columns of the interval that holds them: each start opens one that ends before the next."""
    return as_of_many(points, starts.withColumnRenamed(start, at), by, at, take)


def as_of_many(left: DataFrame, right: DataFrame, by: list[str], at: str, take: list[str]) -> DataFrame:
    key = F.struct(*by) if len(by) > 1 else F.col(by[0])
    l, r = left.withColumn("_k", key), right.select(key.alias("_k"), at, *take)  # noqa: E741
    return as_of(l, r, "_k", at, take).drop("_k", f"{at}_then")


def tiered(queries: DataFrame, rows: DataFrame, tiers: list[Column], key: list[str], order: list[Column]) -> DataFrame:
    """Each query's best row: of the lowest tier that any row meets, the first in order.

    Every tier is a join of its own, so those that are equalities are hash
    joins; a query goes on to the next tier only if the ones before found none.
    """
    first, out, open_ = Window.partitionBy(*key).orderBy(*order), None, queries
    for i, tier in enumerate(tiers):
        met = open_.join(rows, tier).withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").withColumn("tier", F.lit(i))
        out = met if out is None else out.unionByName(met)
        open_ = open_.join(met.select(*key), key, "left_anti")
    return out


def waterfall(keys: DataFrame, on: str, sources: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """keys with the value and the name of the first source (name, table with unique keys, value column) that has one."""
    out, values = keys, []
    for i, (name, source, value) in enumerate(sources):
        out = out.join(source.select(on, F.col(value).alias(f"_v{i}")), on, "left")
        values.append((F.col(f"_v{i}"), name))
    source = F.lit(None).cast("string")
    for v, name in reversed(values):
        source = F.when(v.isNotNull(), name).otherwise(source)
    return out.withColumns({"value": F.coalesce(*[v for v, _ in values]), "found_in": source}).drop(*[f"_v{i}" for i in range(len(sources))])


def not_in(rows: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """SQL's NOT IN: rows whose key is not listed; none at all where the list holds a null, and none with a null key unless the list is empty."""
    told = listed.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col(listed_key).isNull()).alias("_nulls"))
    n, nulls = told.first()
    if nulls:
        return rows.limit(0)
    return rows.filter(F.col(key).isNotNull()).join(listed.select(F.col(listed_key).alias(key)), key, "left_anti").select(*rows.columns) if n else rows


def starting_with(names: DataFrame, name: str, prefix: Column, others: DataFrame, other: str) -> DataFrame:
    """Pairs of a name and another one that starts with the prefix made of the first.

    Every beginning of the other name that is as long as some prefix meets
    that prefix by equality, so no block is compared pair by pair.
    """
    p = names.select(name, prefix.alias("_p"))
    lengths = F.lit(p.agg(F.sort_array(F.collect_set(F.length("_p")))).first()[0] or [0])  # at most as many as the longest prefix has characters
    heads = others.select(other, F.explode(F.transform(F.filter(lengths, lambda n: n <= F.length(other)), lambda n: F.substring(F.col(other), F.lit(1), n))).alias("_p"))
    return p.join(heads, "_p").select(name, other)


def include_or_not_exclusive(rows: DataFrame, tags: DataFrame, key: str, tag: str, wanted: str, exclusive: DataFrame) -> DataFrame:
    """Rows that carry the wanted tag, or none of the exclusive tags."""
    flags = tags.join(exclusive.select(tag).distinct().withColumn("_ex", F.lit(True)), tag, "left").groupBy(key).agg(
        F.max(F.col(tag) == wanted).alias("_in"), F.max(F.coalesce("_ex", F.lit(False))).alias("_any")
    )
    return rows.join(flags, key, "left").filter(F.coalesce("_in", F.lit(False)) | ~F.coalesce("_any", F.lit(False))).drop("_in", "_any")

"""Writing semantics on plain tables: the result of a write is a new version of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(target: DataFrame, source: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Target with the source's rows: listed columns are updated where the key is there, other rows are inserted.

    Keys of the source are unique. As in SQL unique indexes, a row with a null
    in its key meets no other row.
    """
    t, s = target.alias("t"), source.alias("s")
    same = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in key])
    hit, old = F.col(f"s.{key[0]}").isNotNull(), F.col(f"t.{key[0]}").isNotNull()
    cols = [F.when(hit & old, F.col(f"s.{c}") if c in update else F.col(f"t.{c}")).when(old, F.col(f"t.{c}")).otherwise(F.coalesce(f"s.{c}", f"t.{c}")).alias(c) for c in target.columns]
    return t.join(s, same, "full_outer").select(*cols)


def insert_ignore(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    return target.unionByName(source.dropDuplicates(key).join(target.select(*key), key, "left_anti"))


def replace_children(links: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """links without those of any parent that has fresh ones, and the fresh ones."""
    return links.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def delete_where(rows: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Per key of either snapshot: change (added, removed, changed, same) and delta."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return b.join(a, key, "full_outer").select(key, "before", "after", change.alias("change"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def insert_statements(rows: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row, text in quotes with quotes doubled, null as NULL."""

    def literal(name: str, kind: str):
        c = F.col(name)
        shown = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) if kind == "string" else c.cast("string")
        return F.coalesce(shown, F.lit("NULL"))

    values = F.concat_ws(", ", *[literal(c, k) for c, k in rows.dtypes])
    return rows.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))


def surrogate_key(*columns: str):
    """An id that follows from the natural key, the same in every run."""
    return F.xxhash64(*columns)


def fresh(rows: DataFrame, created: str, now, seconds: int) -> DataFrame:
    """Rows of a cache that have not expired."""
    return rows.filter(F.col(created) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)) > now)


def resolve_keys(links: DataFrame, dimension: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """The dimension with the names that it lacked, and links with their keys.

    Names of two letters or more meet without case; a new one gets the first
    spelling and a key that follows from its name in capitals.
    """
    valid = links.filter(F.length(name) >= 2)
    new = valid.groupBy(F.upper(name).alias("_u")).agg(F.min(name).alias(name)).join(dimension.select(F.upper(name).alias("_u")), "_u", "left_anti")
    full = dimension.unionByName(new.select(surrogate_key("_u").alias(key), name), allowMissingColumns=True)
    first = full.groupBy(F.upper(name).alias("_u")).agg(F.min(key).alias(key))
    return full, valid.withColumn("_u", F.upper(name)).join(first, "_u").drop("_u", name).distinct()


def set_status(frontier: DataFrame, done: DataFrame, on: str, status: str) -> DataFrame:
    """frontier with the status of the keys that are done (key, status) set; the key alone tells, so equal keys of other groups are set too."""
    last = done.groupBy(on).agg(F.max(status).alias("_new"))
    return frontier.join(last, on, "left").withColumn(status, F.coalesce("_new", status)).drop("_new").select(*frontier.columns)


def append_log(log: DataFrame, pages: DataFrame, at) -> DataFrame:
    """log with a row per page: url, content_hash, status (success, or failed with an error), at."""
    rows = pages.select("url", F.sha2("html", 256).alias("content_hash"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), "error", at.alias("at"))
    return log.unionByName(rows)


def snapshot(rows: DataFrame, groups: list[str], name: str, at) -> DataFrame:
    """One row per group, as a JSON snapshot keeps it: its number of members and their sorted names."""
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(name)).alias("members")).withColumn("taken_at", at)


def diff_members(before: DataFrame, after: DataFrame, key: str, top: int = 5) -> DataFrame:
    """Per key of two snapshots: change of number, how many members came and went, and the first few of each by name."""
    b, a = before.select(key, F.col("n").alias("n_b"), F.col("members").alias("m_b")), after.select(key, F.col("n").alias("n_a"), F.col("members").alias("m_a"))
    none = F.array().cast("array<string>")
    m_b, m_a = F.coalesce("m_b", none), F.coalesce("m_a", none)
    came, went = F.array_sort(F.array_except(m_a, m_b)), F.array_sort(F.array_except(m_b, m_a))
    return b.join(a, key, "full_outer").select(key, (F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))).alias("delta"), F.size(came).alias("n_came"), F.size(went).alias("n_went"), F.slice(came, 1, top).alias("came"), F.slice(went, 1, top).alias("went"))


def lookup_lists(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Per group its distinct names, sorted: what a lookup module holds."""
    return rows.filter(F.col(name).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(name)).alias("names"))


def import_mappings(own: DataFrame, imported: DataFrame, key: list[str]) -> DataFrame:
    """own mappings and the imported ones whose key (without case, null equal to null) is new; of equal imported keys the first by all columns."""
    low = lambda df, p: df.select("*", *[F.lower(F.coalesce(c, F.lit(""))).alias(f"{p}{i}") for i, c in enumerate(key)])
    keys = [f"_k{i}" for i in range(len(key))]
    new = low(imported, "_k").join(low(own, "_k").select(*keys), keys, "left_anti")
    return own.unionByName(latest(new, keys, [F.struct(*imported.columns)]).select(*imported.columns))


def expected_missing(expected: list[str], rows: DataFrame, name: str) -> DataFrame:
    """The expected names that no row has."""
    want = rows.sparkSession.createDataFrame([(x,) for x in expected], f"{name} string")
    return want.join(rows.select(name), name, "left_anti")


def cache_stats(rows: DataFrame, content: str, created: str) -> DataFrame:
    """One row: entries, characters in all, oldest and newest."""
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.length(content)), F.lit(0)).cast("bigint").alias("characters"), F.min(created).alias("oldest"), F.max(created).alias("newest"))


def resource_uris(scheme: str, parents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(uri, name): a resource per parent (slug, name), and per child (parent, slug, name) of each kind under its parent."""
    out = parents.select(F.concat(F.lit(f"{scheme}://parents/"), "slug").alias("uri"), "name")
    for kind, rows in children.items():
        out = out.union(rows.select(F.concat(F.lit(f"{scheme}://parents/"), "parent", F.lit(f"/{kind}/"), "slug"), "name"))
    return out

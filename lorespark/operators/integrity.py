"""Data-quality checks; each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """Keys that occur twice or more, with how often, all ids, and the one that survives."""
    ids = F.array_sort(F.collect_set(id_column))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"), F.min(id_column).alias("survivor")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def childless(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    return parents.join(children, parents[parent_key] == children[child_key], "left_anti")


def name_faults(c: Column, longest: int = 100) -> Column:
    """Names of the rules that a name breaks."""
    rules = {
        "blank": F.trim(c) == "",
        "lowercase": (c == F.lower(c)) & c.rlike("[a-z]"),
        "too_long": F.length(c) > longest,
        "markup": c.rlike(r"&[a-z]+;|<[^>]+>"),
        "numbered": c.rlike(r" \d+$"),
        "unfinished": c.rlike(r"(?i) (?:of|the|and|with)$"),
    }
    return F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())


# Spellings that mark a name as a stratagem, an ability or a resource and not as a unit; letters of either case.
NOT_A_UNIT = [
    r"\(stratagem",
    r"\(ability",
    r"\(rule",
    r"\(reserve",
    r"\(detachment",
    r"\(resource",
    r"\(reference\)",
    r"stratagem\s*/\s*ability",
    r"ability\s*/\s*stratagem",
    r"resurgent points",
    r"cult ambush.*token",
]


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns occurs in a text, in letters of either case."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(f"(?i){p}")
    return out


def misclassified(c: Column) -> Column:
    """Whether a unit's name is that of something else."""
    return any_of(c, NOT_A_UNIT)


def counts_of(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: its name and number of rows."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def near_duplicate_slugs(rows: DataFrame, slug: str, group: list[str]) -> DataFrame:
    """Slugs that are equal but for a trailing number."""
    base = F.regexp_replace(slug, r"-\d+$", "")
    return rows.groupBy(*group, base.alias("base")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(slug)).alias("slugs")).filter(F.size("slugs") > 1)


def staleness(rows: DataFrame, updated: str, now: Column, days: int = 30) -> DataFrame:
    """rows with age in whole days and whether it is over the limit; never updated counts as stale."""
    age = F.floor((F.unix_millis(now) - F.unix_millis(updated)) / F.lit(86_400_000))
    return rows.withColumns({"age_days": age.cast("bigint"), "stale": age.isNull() | (age > days)})

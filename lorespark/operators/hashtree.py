"""Large sets of members compared by trees of sums over hashed ranges.

A tree holds, for each group and each range of its members' hashes, how many
there are and what their hashes add up to: 16 ranges at the first level, 256
at the second and so on. Two sets are compared from the top, going down only
where the sums differ, so what is read and shuffled of the members follows what
has changed. A tree is a small table that can be kept beside its snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.scratch import Scratch

#: Ranges that each one is cut into at the next level, as bits, and levels.
BITS, LEVELS = 4, 3

TREE = ["level", "range", "n", "s1", "s2"]


def _hash(group: list[str], name: str) -> Column:
    return F.xxhash64(*group, name)


def _range(level: int) -> Column:
    """The range that a member lies in at a level, by the high bits of its hash."""
    return F.shiftrightunsigned(F.col("_h"), 64 - BITS * level) if level else F.lit(0).cast("bigint")


def member_tree(rows: DataFrame, group: list[str], name: str, levels: int = LEVELS) -> DataFrame:
    """group..., level, range, n, s1, s2: the sums of distinct members (null ones left out) over the ranges of every level, 0 being the whole group."""
    once = rows.select(*group, name).filter(F.col(name).isNotNull()).distinct().withColumn("_h", _hash(group, name))
    low = lambda c, bits: c.bitwiseAND((1 << bits) - 1)
    leaf = once.groupBy(*group, _range(levels).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.sum(low(F.col("_h"), 31)).alias("s1"), F.sum(low(F.shiftrightunsigned("_h", 31), 31)).alias("s2"))
    out = leaf.withColumn("level", F.lit(levels))
    for level in range(levels - 1, -1, -1):
        up = leaf.groupBy(*group, F.shiftrightunsigned("range", BITS * (levels - level)).alias("range")).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
        out = out.unionByName(up.withColumn("level", F.lit(level)))
    return out.select(*group, *TREE)


def changed_ranges(before: DataFrame, after: DataFrame, group: list[str], levels: int = LEVELS) -> DataFrame:
    """(group..., range): the ranges of the last level whose sums differ between two trees; below a range whose sums agree nothing is looked at."""
    scratch = Scratch(before.sparkSession, "ranges")

    def differing(level: int, within: DataFrame | None) -> DataFrame:
        sides = [t.filter(F.col("level") == level).select(*group, "range", F.struct("n", "s1", "s2").alias(side)) for t, side in ((before, "b"), (after, "a"))]
        if within is not None:
            up = within.withColumnRenamed("range", "_up")
            sides = [s.withColumn("_up", F.shiftrightunsigned("range", BITS)).join(up, [*group, "_up"], "left_semi").drop("_up") for s in sides]
        return sides[0].join(sides[1], [*group, "range"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*group, "range")

    now = None
    for level in range(levels + 1):
        now = scratch.write(differing(level, now), f"level{level}")
    return now


def changed_members(before: DataFrame, after: DataFrame, group: list[str], name: str, trees: tuple[DataFrame, DataFrame] | None = None, levels: int = LEVELS) -> DataFrame:
    """(group..., name, change): members that came (added) and went (removed) between two sets of rows.

    Null members are left out, repeated ones count once. trees: what
    member_tree() made of both sides earlier, else they are made here. Groups
    have no nulls. Members of ranges whose sums agree are not compared: that
    different ones give equal numbers and sums of 62 bits of hashes is the only
    chance of a miss.
    """
    trees = trees or (member_tree(before, group, name, levels), member_tree(after, group, name, levels))
    changed = changed_ranges(*trees, group, levels)

    def inside(rows: DataFrame, side: str) -> DataFrame:
        placed = rows.select(*group, name).filter(F.col(name).isNotNull()).withColumn("_h", _hash(group, name)).withColumn("range", _range(levels))
        return placed.join(changed, [*group, "range"], "left_semi").select(*group, name).distinct().withColumn(side, F.lit(True))

    both = inside(before, "_b").join(inside(after, "_a"), [*group, name], "full_outer").filter("_a is null or _b is null")
    return both.select(*group, name, F.when(F.col("_a").isNull(), "removed").otherwise("added").alias("change"))

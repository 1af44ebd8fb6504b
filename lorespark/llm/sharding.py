"""Sharding by a hierarchical weighted hash tree.

A document descends from the root: at each node every child draws a number
hashed from the document and the child, weighted by the capacity below it, and
the best draw wins (weighted rendezvous hashing). Changing a child's weight
moves documents only into it or out of it, so nothing moves in subtrees whose
weights stay. A shard added later becomes a child of the root with a region
and rack of its own: it takes documents only into itself, and no other weight
changes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorespark.llm.common import Scratch, documents, sized

#: Sub-ranges that each shard's slots are counted in; fixed, so the table of counts has a proven bound.
RANGES = 1024


@dataclass(frozen=True)
class Topology:
    """weights[region][rack][shard]: capacity of each shard; shards are numbered in that order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, regions: int = 5, racks: int = 2, shards: int = 4) -> Topology:
        return cls((((1.0,) * shards,) * racks,) * regions)

    def grown(self, weight: float = 1.0) -> Topology:
        """With one more shard, in a region of its own."""
        return replace(self, weights=(*self.weights, ((weight,),)))

    @property
    def n_shards(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _key() -> Column:
    """What is hashed of a row: doc_id; rows without one are told apart by their text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))


def _hex(hashed: Column, digits: int) -> Column:
    return F.conv(F.substring(hashed, 1, digits), 16, 10)


def _draw(level: str, node: Column, child: Column, weight: Column, key: Column) -> Column:
    """Exponential draw -ln(u) / weight of a child of a node."""
    u = (_hex(F.md5(F.concat_ws("/", F.lit(level), node, child.cast("string"), key)), 12).cast("double") + 0.5) / float(2**48)
    return -F.ln(u) / weight


def _winner(level: str, node: Column, weights: Column, key: Column) -> Column:
    """(e, i): the smallest draw among the children of a node, and which one drew it."""
    return F.array_min(F.transform(weights, lambda weight, i: F.struct(_draw(level, node, i, weight, key).alias("e"), i.alias("i"))))


def descend(rows: DataFrame, tree: Topology, key: str) -> DataFrame:
    """rows with shard (one draw for the region, one for the rack there, one for the shard there) and region_draw, the region's."""
    w = tree.weights
    first, number = [], 0
    for region in w:
        first.append([])
        for rack in region:
            first[-1].append(number)
            number += len(rack)
    lit = lambda x: F.array(*[lit(y) for y in x]) if isinstance(x, (list, tuple)) else F.lit(x)
    region_w = lit([float(sum(map(sum, region))) for region in w])
    rack_w = lit([[float(sum(rack)) for rack in region] for region in w])
    shard_w = lit([[[float(x) for x in rack] for rack in region] for region in w])
    region = rows.withColumn("_region", _winner("region", F.lit("root"), region_w, F.col(key)))
    at = F.col("_region.i")
    rack = region.withColumn("_rack", _winner("rack", at.cast("string"), rack_w[at], F.col(key))["i"])
    leaf = rack.withColumn("_leaf", _winner("shard", F.concat_ws(".", at.cast("string"), F.col("_rack").cast("string")), shard_w[at][F.col("_rack")], F.col(key))["i"])
    return leaf.withColumns({"shard": (lit(first)[at][F.col("_rack")] + F.col("_leaf")).cast("int"), "region_draw": F.col("_region.e")}).drop("_region", "_rack", "_leaf")


def shard(docs: DataFrame, tree: Topology = Topology.even(), new_weight: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes count the UTF-8 bytes of the text (null: none) plus 16; texts of any
    length count whole. grown_shard is the shard in Topology.grown(new_weight):
    only the new region has a draw of its own to make there. Slots number each
    shard's rows from 0 without gaps, in the order of a hashed sub-range, then
    doc_id: sub-range counts are summed first, so no task sorts a whole shard.
    Repeated rows get slots of their own. A null doc_id is placed by its text,
    and its sub-range by its row. Other columns are not looked at, whatever
    their names. Empty docs give an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        _key().alias("_key"),
        F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id().cast("string")).otherwise("").alias("_row"),
    )
    ranged = keyed.withColumn("_range", F.pmod(_hex(F.md5(F.concat(F.lit("slot/"), "_key", "_row")), 8).cast("bigint"), F.lit(RANGES)).cast("int"))
    new = _draw("region", F.lit("root"), F.lit(len(tree.weights)), F.lit(float(new_weight)), F.col("_key"))
    grown = F.when(new < F.col("region_draw"), F.lit(tree.n_shards)).otherwise(F.col("shard"))
    placed = descend(ranged, tree, "_key").withColumn("grown_shard", grown.cast("int")).drop("_key", "_row", "region_draw")
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.write(placed, "rows")

    # At most n_shards * RANGES counts, whatever the input; many shards make too many to broadcast.
    counts = rows.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = scratch.write(counts.select("shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")), "starts")
    inside = Window.partitionBy("shard", "_range").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    slotted = rows.withColumn("_in", F.row_number().over(inside) - 1).join(sized(starts), ["shard", "_range"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_in")).cast("bigint").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))

"""What can be reached over links, in rounds over what is new.

Each round joins only the pairs that the round before found (semi-naive
evaluation) and keeps those not seen yet, so cycles end and a link is followed
once for each start. A round's pairs are written to the shared folder as a part
of one table, so the plan of a round does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lorespark.scratch import Scratch


def reachable(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, node, steps): nodes that each start reaches over links, itself included with 0 steps, each with the fewest steps.

    starts: start. links: a, b, of the same type. Nulls start and link
    nothing; repeated rows count once; a node that only starts is reached by
    itself; cycles are followed once round.
    """
    scratch = Scratch(starts.sparkSession, "reachable")
    edges = scratch.write(links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), "links")
    first = starts.select("start").filter("start is not null").distinct()
    new = scratch.write(first.select("start", F.col("start").alias("node")), "seen/steps=0")
    shape, n = StructType([*new.schema.fields, StructField("steps", IntegerType())]), 0
    while not new.isEmpty():
        # The rounds so far are one table, however many they are: what is in it has been reached in fewer steps.
        seen, n = scratch.spark.read.schema(shape).parquet(f"{scratch.root}/seen"), n + 1
        met = new.join(edges, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct()
        new = scratch.write(met.join(seen.select("start", "node"), ["start", "node"], "left_anti"), f"seen/steps={n}")
    return scratch.spark.read.schema(shape).parquet(f"{scratch.root}/seen")

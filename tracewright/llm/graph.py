"""Connected components by alternating star contraction (Kiveris et al., SoCC 2014) as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b: long) to ``(node, root)``: each node of an edge with the smallest node it reaches.

    Every round re-links neighbours to the smallest one and halves, roughly, the height of the
    forest; rows never exceed the number of edges. A hub is met only in aggregates with map-side
    combining and in joins whose other side has one row for each key and is written first, so that
    Spark can split the hub's partition. Null ends are left out; loops
    and repeated edges do no harm; no edges give no rows.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    while not _stars(e):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, name)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least).distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node of ``e`` (u, v) either has one edge to its root or is a root."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), one.alias("up"), none.alias("root")), F.struct(F.col("v").alias("x"), none.alias("up"), one.alias("root")))).alias("e"))
    ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.root").alias("root"))
    return ends.agg(F.count_if(F.expr("up > 1 or (up = 1 and root = 1)"))).first()[0] == 0

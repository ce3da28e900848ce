"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every linked node; the label is the smallest node reachable.

    Each half round replaces the links of a node by links to the smallest node around it,
    so the number of links never grows. No links give no rows; self links and repeated
    links do not matter; rows with a null end are ignored.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct())
    mark = (F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    before = edges.agg(*mark).first()
    while before.n:
        # large star: neighbours above a node go to the smallest around it
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: a node and the smaller nodes around it go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = edges.agg(*mark).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())

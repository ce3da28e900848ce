"""K-d tree partitioning of documents by bytes.

Groups of equal texts are the points, their bytes the weights. A node that is heavier than
the target is cut at the weighted median of its widest dimension; all nodes of a level are
cut together. The medians are distributed: a range sort by node and coordinate, sums per
partition, and a running sum within each partition give every point its place. Groups that
weigh a good part of a shard are placed before, and the cuts leave room for them.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import small_table
from .common import materialize, table

#: A node is cut while it is heavier than so many targets; a group is placed on its own from
#: such a share of a shard on.
CUT_OVER, PLACED_SHARE = 1.5, 1 / 16


def text_code(c: Column) -> Column:
    """The first six bytes of a text as a number, in their order; null is zero."""
    b = F.rpad(F.substring(F.coalesce(c, F.lit("")).cast("binary"), 1, 6), 6, F.lit(b"\0"))
    return F.conv(F.hex(b), 16, 10).cast("double")


def sort_with_place(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` range-sorted and stored, with its partition ``pid`` and row number ``at`` there."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    placed = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(placed.withColumn("pid", F.shiftright(row, 33).cast("int")).withColumn("at", row.bitwiseAND((1 << 33) - 1)))


def number_within(df: DataFrame, group: str, *order: str, name: str = "slot") -> DataFrame:
    """A gapless number from 0 within ``group`` in the given order, without a window over a group."""
    placed = sort_with_place(df, group, *order)
    counts = placed.groupBy("pid", group).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(counts.select(F.col("pid").alias("p"), F.col(group).alias("g"), (before - F.col("first")).alias("offset")))
    return placed.join(offsets, (F.col("pid") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))).drop("p", "g").withColumn(name, F.col("at") + F.col("offset")).drop("pid", "at", "offset")


def _nodes(tree: DataFrame, dimensions: Sequence[str], weight: str, total: Row) -> DataFrame:
    """(node, node_weight, points, axis): per node its widest dimension, as a share of the whole table's range."""
    spans = [F.when(F.lit(bool(total[d])), (F.max(d) - F.min(d)) / F.lit(float(total[d] or 1))).otherwise(0.0).alias(f"w{i}") for i, d in enumerate(dimensions)]
    nodes = tree.groupBy("node").agg(F.sum(weight).alias("node_weight"), F.count("*").alias("points"), *spans)
    widest = F.greatest(F.lit(-1.0), *[F.col(f"w{i}") for i in range(len(dimensions))])
    axis = F.coalesce(*[F.when(F.col(f"w{i}") == widest, i) for i in range(len(dimensions))])
    return nodes.select("node", "node_weight", "points", axis.alias("axis"))


def _cut(tree: DataFrame, nodes: DataFrame, dimensions: Sequence[str], weight: str, tie: Sequence[str]) -> DataFrame:
    """``tree`` after the nodes in ``nodes`` (node, node_weight, axis, share, left, right) are cut.

    ``share`` of a node's weight goes to the left: a half is the weighted median.
    """
    value = F.element_at(F.array(*[F.col(d).cast("double") for d in dimensions]), F.col("axis") + 1)
    ranked = sort_with_place(tree.join(nodes, "node", "left").withColumn("value", F.coalesce(value, F.lit(0.0))), "node", "value", *tie)
    sums = ranked.groupBy("pid", "node").agg(F.sum(weight).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("node").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(sums.select("pid", "node", before.alias("before")))
    running = F.sum(weight).over(Window.partitionBy("pid", "node").orderBy("at"))
    middle = F.col("before") + running - F.col(weight) / 2
    side = F.when(F.col("node_weight").isNull(), F.col("node")).when(
        middle > F.col("node_weight") * F.col("share"), F.col("right")).otherwise(F.col("left"))
    return materialize(ranked.join(offsets, ["pid", "node"]).withColumn("node", side).select(tree.columns))


def _ranges(points: DataFrame, dimensions: Sequence[str]) -> Row:
    return points.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dimensions]).first()


def kd_leaves(points: DataFrame, dimensions: Sequence[str], weight: str, tie: Sequence[str], target: float, depth: int) -> DataFrame:
    """``points`` with a number ``leaf`` from 0, along the tree from left to right.

    Nodes heavier than ``CUT_OVER`` targets are cut at their weighted medians, at most
    ``depth`` times. The widest dimension is the one with the largest range as a share of
    the whole table's, of equal ones the first. Points of equal coordinates follow in the
    order of ``tie``. Dimensions must not be null. No points give no rows.
    """
    total = _ranges(points, dimensions)
    tree = materialize(points.withColumn("node", F.lit(1).cast("long")))
    for _ in range(depth):
        nodes = _nodes(tree, dimensions, weight, total).where((F.col("node_weight") > CUT_OVER * target) & (F.col("points") > 1))
        nodes = materialize(nodes.select(
            "node", "node_weight", "axis", F.lit(0.5).alias("share"), (F.col("node") * 2).alias("left"), (F.col("node") * 2 + 1).alias("right")))
        if nodes.isEmpty():
            break
        tree = _cut(tree, nodes, dimensions, weight, tie)
    # left to right: nodes as numbers of equal length
    level = F.floor(F.log2("node"))
    place = F.expr(f"shiftleft(node, cast({depth} - floor(log2(node)) as int))")
    order = tree.select("node").distinct().withColumn("p", place).withColumn("l", level)
    leaves = order.withColumn("leaf", (F.row_number().over(Window.orderBy("p", "l")) - 1).cast("int")).select("node", "leaf")
    return tree.join(leaves, "node").drop("node")


def kd_fill(points: DataFrame, dimensions: Sequence[str], weight: str, tie: Sequence[str], capacities: Sequence[float]) -> DataFrame:
    """``points`` with a number ``leaf``: the tree has one leaf per capacity, and cuts by them.

    A node stands for a run of leaves. It is cut between its two halves of leaves, where the
    weight to the left is to that of the node as the left capacities to all of the node: at
    the weighted median when they are equal.
    """
    total = _ranges(points, dimensions)
    tree = materialize(points.withColumn("node", F.lit(0).cast("long")))
    runs = [(0, len(capacities))]
    while any(hi - lo > 1 for lo, hi in runs):
        plan, halves = [], []
        for lo, hi in runs:
            mid = (lo + hi + 1) // 2
            if hi - lo > 1:
                whole = sum(capacities[lo:hi])
                plan.append((lo, sum(capacities[lo:mid]) / whole if whole > 0 else (mid - lo) / (hi - lo), lo, mid))
                halves += [(lo, mid), (mid, hi)]
            else:
                halves.append((lo, hi))
        cuts = points.sparkSession.createDataFrame(plan, "node long, share double, left long, right long")
        nodes = materialize(_nodes(tree, dimensions, weight, total).drop("points").join(cuts, "node"))
        tree = _cut(tree, nodes, dimensions, weight, tie)
        runs = halves
    return tree.withColumn("leaf", F.col("node").cast("int")).drop("node")


def _heavy_places(pieces: Sequence[Row], shards: int) -> tuple[list[tuple], list[float]]:
    """(group, piece, shard) with the heaviest first, each into the shard with the least so far; and the loads."""
    loads = [(0, k) for k in range(shards)]
    places = []
    for r in sorted(pieces, key=lambda r: (-r.bytes, bytes(r.group), r.piece)):
        load, k = heapq.heappop(loads)
        places.append((bytes(r.group), r.piece, k))
        heapq.heappush(loads, (load + r.bytes, k))
    return places, [float(load) for load, _ in sorted(loads, key=lambda x: x[1])]


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("lang", "source")) -> DataFrame:
    """Row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    The dimensions are the size and the texts in ``metadata``; a group of equal texts has the
    smallest of each. Equal texts share a shard; only a group that outweighs a shard is torn,
    into as few pieces as fit. Groups over a sixteenth of a shard, of which there are at most
    16 per shard, are placed first, each into the emptiest shard, and the tree deals the
    others so that all shards become equal. The law is ``bytes``. A null text counts as empty.
    Null and repeated ids are dealt like others, null ids first in the order of slots. A
    table with fewer groups than shards fills fewer of them; an empty one gives no rows.
    """
    if shards < 1:
        raise ValueError("There must be a shard.")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = materialize(docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(data, 256)), 1, 16).alias("group"), *[text_code(F.col(m)).alias(f"m{i}") for i, m in enumerate(metadata)],
        F.monotonically_increasing_id().alias("row")))
    names = [f"m{i}" for i in range(len(metadata))]
    target = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    heavy = rows.groupBy("group").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target * PLACED_SHARE)
    pieces = F.when(F.col("bytes") > target, F.ceil(F.col("bytes") / F.lit(max(1.0, target)))).otherwise(1)
    heavy = materialize(heavy.select("group", pieces.cast("long").alias("pieces")))
    apart = rows.join(heavy, "group").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")))
    weights = apart.groupBy("group", "piece").agg(F.sum("size").alias("bytes")).collect()  # at most 17 per shard
    places, loads = _heavy_places(weights, shards)
    where = small_table(docs.sparkSession, places, "group binary, piece long, shard int")
    placed = apart.join(where, ["group", "piece"])
    light = rows.join(heavy, "group", "left_anti")
    groups = light.groupBy("group").agg(F.sum("size").alias("bytes"), F.first("size").alias("size"), *[F.min(m).alias(m) for m in names])
    leaves = kd_fill(groups, ["size", *names], "bytes", ["group"], [max(0.0, target - x) for x in loads])
    columns = ["doc_id", "size", "text_crc32", "shard"]
    dealt = placed.select(*columns).unionByName(light.join(leaves.select("group", F.col("leaf").alias("shard")), "group").select(*columns))
    return number_within(dealt, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

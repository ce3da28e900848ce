"""Text in the order of its files: numbered pieces, and JSON arrays cut into their elements.

Files are read by many tasks; the place of a piece is its file, the block the task began at,
and its position there. Running sums over all pieces are taken in two steps, within the
blocks and over one row per block, so no task sees a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize, settle

PLACE = ["file", "block", "pos"]


def read_pieces(spark: SparkSession, path: str, separator: str | None = None, blank: bool = True) -> DataFrame:
    """(file, block, pos, value) of the text at ``path``, cut at line ends or at ``separator``. Stored at once.

    Within a block ``pos`` goes up by one. Without ``blank``, blank pieces are left out.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    meta = F.col("_metadata")
    rows = reader.text(path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    rows = rows if blank else rows.where(F.trim("value") != "")
    return materialize(rows.select("file", "block", F.monotonically_increasing_id().alias("pos"), "value"))


def numbered(pieces: DataFrame, name: str) -> DataFrame:
    """``pieces`` as ``read_pieces`` stored them, all of them, numbered from 0 over all files.

    The texts stay where they are: only one row per block is shuffled.
    """
    blocks = pieces.groupBy("file", "block").agg(F.count("*").alias("__s"), F.min("pos").alias("__first"))
    over = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(blocks.select("file", "block", (F.coalesce(F.sum("__s").over(over), F.lit(0)) - F.col("__first")).alias("__o")))
    return pieces.join(offsets, ["file", "block"]).withColumn(name, F.col("pos") + F.col("__o")).drop("__o")


def running(pieces: DataFrame, amount: Column, name: str, per_file: bool = True) -> DataFrame:
    """``pieces`` with the sum of ``amount`` over all pieces in front, of the file or of all files."""
    marked = pieces.withColumn("__a", amount.cast("bigint"))
    blocks = marked.groupBy("file", "block").agg(F.sum("__a").alias("__s"))
    over = (Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("file", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("__i", F.coalesce(F.sum("__a").over(inside), F.lit(0)))
        .join(offsets, ["file", "block"]).withColumn(name, F.col("__i") + F.col("__o")).drop("__a", "__i", "__o")
    )


def _outside(value: Column) -> Column:
    """What of a piece that begins outside a string lies outside strings."""
    closed = F.regexp_replace(value, r'"(?:[^"\\]|\\.)*+"', "")
    return F.regexp_replace(closed, r'(?s)".*$', "")


def _depth(value: Column) -> Column:
    """Opening less closing brackets of a piece that begins outside a string."""
    rest = _outside(value)
    opened = F.length(F.regexp_replace(rest, r"[^\[{]", ""))
    return opened - F.length(F.regexp_replace(rest, r"[^\]}]", ""))


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(file, no, value): the elements of one JSON array per file, as text, numbered from 0.

    The files are cut at all commas. Whether a piece begins inside a string follows from
    the number of quotes in front, and how deep it lies from the brackets in front; commas
    at depth one part the elements. Pieces of an element are put together again, so only
    one element has to fit in a task. An escape never spans a comma.
    """
    pieces = read_pieces(spark, path, ",")
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r'\\.', ""), r'[^"]', ""))
    pieces = running(pieces, quotes, "__q").withColumn("__in", F.col("__q") % 2 == 1)
    begun = F.when(F.col("__in"), F.concat(F.lit('"'), "value")).otherwise(F.col("value"))
    pieces = materialize(pieces.withColumn("__d", _depth(begun)).withColumn("__end_in", (F.col("__q") + quotes) % 2 == 1))
    pieces = running(pieces, F.col("__d"), "__before")
    # the comma behind a piece parts elements when the piece ends at depth one, outside strings
    parts = ~F.col("__end_in") & (F.col("__before") + F.col("__d") == 1)
    pieces = running(pieces, parts.cast("int"), "no")
    place = F.struct("block", "pos", "value")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda p: p["value"]), ",")
    whole = pieces.groupBy("file", "no").agg(text.alias("t"))
    last = whole.groupBy("file").agg(F.max("no").alias("__last"))
    body = F.when(F.col("no") == 0, F.regexp_replace("t", r"^\s*\[", "")).otherwise(F.col("t"))
    body = F.when(F.col("no") == F.col("__last"), F.regexp_replace(body, r"\]\s*$", "")).otherwise(body)
    return whole.join(last, "file").select("file", "no", F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("value")).where("value <> ''")

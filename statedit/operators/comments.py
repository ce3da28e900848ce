"""Versioned comments: one active comment per unit (general) or per unit and variable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join

# A general comment has a null variable, so keys compare null-safe.
KEY = ["unit", "level", "variable"]


def _single(rows: DataFrame, message: str) -> DataFrame:
    """The keys of ``rows``; the job fails where one occurs twice."""
    counted = rows.groupBy(*KEY).agg(F.count("*").alias("__n"))
    return counted.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))).select(*KEY)


def add_comment(comments: DataFrame, new: DataFrame) -> DataFrame:
    """Switch off the active comments of the keys in ``new`` and add its rows as active.

    ``new`` has one row per key with ``id, unit, level, variable, comment, created_at,
    created_by``; a missing text is stored as empty. Two rows of one key fail the job.
    """
    keys = _single(new, "Two new comments of one key.").withColumn("__hit", F.lit(True))
    closed = null_safe_join(comments, keys, KEY, "left").withColumn(
        "active", F.col("active") & F.col("__hit").isNull()
    ).drop("__hit")
    added = new.withColumn("comment", F.coalesce("comment", F.lit(""))).withColumn(
        "active", F.lit(True)
    ).withColumn("version", F.lit(1))
    fields = comments.columns
    return closed.unionByName(added.select(*[
        (F.col(c) if c in added.columns else F.lit(None)).cast(comments.schema[c].dataType).alias(c) for c in fields
    ]))


def activate_comment(comments: DataFrame, ids: DataFrame) -> DataFrame:
    """Make the comments in ``ids(id)`` the active ones of their keys.

    Two ids of one key, and an id that two comments have, fail the job.
    """
    chosen = comments.join(ids.select("id").distinct(), "id", "left_semi").select("id", *KEY)
    keys = _single(chosen, "Two comments of one key cannot both be active.").withColumn("__hit", F.lit(True))
    picked = ids.select("id").distinct().withColumn("__on", F.lit(True))
    active = F.when(F.col("__on"), True).when(F.col("__hit"), False).otherwise(F.col("active"))
    return (
        null_safe_join(comments, keys, KEY, "left").join(picked, "id", "left")
        .withColumn("active", active).select(*comments.columns)
    )


def deactivate_comment(comments: DataFrame, ids: DataFrame) -> DataFrame:
    picked = ids.select("id").distinct().withColumn("__off", F.lit(True))
    return (
        comments.join(picked, "id", "left")
        .withColumn("active", F.col("active") & F.col("__off").isNull()).select(*comments.columns)
    )

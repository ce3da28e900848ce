"""Which response, version or comment counts: the latest-per-key operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import matches
from ..functions.frames import null_safe_join, one_per_key
from ..functions.periods import YEARLY, Spine


def latest_active(
    receipts: DataFrame,
    form: str | None = None,
    filters: Mapping[str, Any] | None = None,
    keys: Sequence[str] = ("unit",),
) -> DataFrame:
    """Newest active response per unit.

    The default key is the unit alone: several periods in the input collapse to one row
    per unit. Ties on the receipt time go to the highest ``ref``.
    """
    rows = receipts.where(F.col("active")).where(matches(filters))
    if form and form != "all":
        rows = rows.where(F.col("form") == form)
    return one_per_key(rows, keys, [F.col("received_at").desc_nulls_last(), F.col("ref").desc()])


def latest_active_per_period(
    receipts: DataFrame,
    form: str | None = None,
    filters: Mapping[str, Any] | None = None,
    periods: Sequence[str] = ("period",),
) -> DataFrame:
    return latest_active(receipts, form, filters, keys=[*periods, "unit"])


def latest_comment(comments: DataFrame, level: str) -> DataFrame:
    """Newest active comment per (unit, variable), or per unit for ``level='general'``."""
    keys = ["unit"] if level == "general" else ["unit", "variable"]
    rows = comments.where(F.col("active") & (F.col("level") == level))
    return one_per_key(rows, keys, [F.col("created_at").desc_nulls_last(), F.col("id").desc()])


def with_update_counts(versions: DataFrame, update_counts: DataFrame) -> DataFrame:
    """Number of edits per version, 0 where none is recorded."""
    return versions.join(update_counts.select("seq", "n_changes"), "seq", "left").withColumn(
        "n_changes", F.coalesce("n_changes", F.lit(0).cast("bigint"))
    )


def active_version(versions: DataFrame, update_counts: DataFrame, keys: Sequence[str] = ("unit", "period")) -> DataFrame:
    """Per (unit, period): edited versions first, then the newest."""
    return default_version(with_update_counts(versions, update_counts), keys)


def default_version(versions: DataFrame, keys: Sequence[str] = ("unit", "period")) -> DataFrame:
    """Newest edited version per key, otherwise the newest received one."""
    order = [
        (F.col("n_changes") > 0).desc(),
        F.col("received_at").desc_nulls_last(),
        F.col("seq").desc(),
    ]
    return one_per_key(versions, keys, order)


def comparable_versions(versions: DataFrame, period: Any, spine: Spine = YEARLY) -> DataFrame:
    """All versions of ``period`` plus the default version of each other period, labelled."""
    text = F.concat(
        F.lit("v"), F.col("version_no").cast("string"), F.lit(" – "),
        F.date_format("received_at", "yyyy-MM-dd HH:mm"),
        F.when(F.col("n_changes") > 0, " (editert)").otherwise(""),
    )
    chosen = spine.is_in([spine.period(period)])
    this = versions.where(chosen).withColumn("label", text)
    other = default_version(versions.where(~chosen), ["unit", *spine.columns]).withColumn(
        "label", F.concat_ws("-", *[F.col(c).cast("string") for c in spine.columns])
    )
    return this.unionByName(other)


def is_latest_version(versions: DataFrame, keys: Sequence[str] = ("unit", "period")) -> DataFrame:
    """Flag the newest received version of each key.

    The newest version is found by a partial aggregate and joined back, so the rows of
    one large key never have to meet in one task.
    """
    newest = one_per_key(
        versions.select(*keys, "received_at", "seq"), keys,
        [F.col("received_at").desc_nulls_last(), F.col("seq").desc()],
    ).select(*keys, F.col("seq").alias("__latest"))
    return (
        null_safe_join(versions, newest, keys, "left")
        .withColumn("is_latest", F.col("seq") == F.col("__latest"))
        .drop("__latest")
    )


def duplicate_submissions(receipts: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Every response, with ``hit`` where its unit sent more than one."""
    rows = receipts.where(matches(filters))
    counts = rows.groupBy("unit").agg((F.count("*") > 1).alias("hit"))
    return null_safe_join(rows, counts, ["unit"], "inner")

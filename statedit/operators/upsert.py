"""Insert, upsert and replace as joins; writing is left to ``sources``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join
from ..scratch import measured


def insert_new(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose key it lacks; columns align by name."""
    fresh = null_safe_join(new, existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def upsert(
    existing: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str], outcome: str = "outcome"
) -> DataFrame:
    """Set ``set_cols`` where the key exists, insert otherwise.

    ``outcome`` says ``inserted``, ``updated`` or ``untouched``. A null in an update is
    written. Both sides must be unique on the key, so the join has no hot key.

    The updates are computed and stored right away. A batch whose files are below the
    threshold of broadcasts leaves the existing table in place; a larger one meets it in a
    full outer join.
    """
    updates, small = measured(updates)

    def marked(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c).alias(f"__u_{c}") for c in updates.columns], F.lit(True).alias("__u"))

    stored = existing.withColumn("__e", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__u_{k}")) for k in keys])
    if small:
        found = null_safe_join(existing.select(*keys), updates.select(*keys), keys, "left_semi")
        added = marked(null_safe_join(updates, found, keys, "left_anti"))
        joined = stored.join(marked(updates), on, "left").unionByName(added, allowMissingColumns=True)
    else:
        joined = stored.join(marked(updates), on, "full_outer")

    def merged(c: str):
        if c not in updates.columns:
            return F.col(c)
        new = F.col(f"__u_{c}").cast(existing.schema[c].dataType)
        if c in set_cols:
            return F.when(F.col("__u"), new).otherwise(F.col(c)).alias(c)
        return F.when(F.col("__e"), F.col(c)).otherwise(new).alias(c)

    state = (
        F.when(F.col("__e").isNull(), "inserted").when(F.col("__u").isNull(), "untouched").otherwise("updated")
    )
    return joined.select(*[merged(c) for c in existing.columns], state.alias(outcome))


def replace_scope(existing: DataFrame, new: DataFrame, scope: DataFrame) -> DataFrame:
    """Delete the rows whose scope columns occur in ``scope``, then add ``new``.

    Columns align by name. An empty ``new`` still deletes.
    """
    kept = null_safe_join(existing, scope.distinct(), scope.columns, "left_anti")
    return kept.unionByName(new.select(*existing.columns))

"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal or both-null keys, keeping the left copy of the keys.

    Catalyst still plans ``<=>`` as an equi-join, so this stays a hash or merge join.
    """
    alias = {k: f"__r_{k}" for k in keys}
    right = right.withColumnsRenamed(alias)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(alias[k])) for k in keys])
    joined = left.join(right, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*alias.values())


def attach(rows: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group statistics to every row of ``rows``.

    Without groups ``stats`` is one row and becomes a scalar subquery. With groups it
    is an equi-join that AQE turns into a broadcast when the statistics are small, and
    whose hot groups it splits otherwise.
    """
    if by:
        return null_safe_join(rows, stats, by, "inner")
    single = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return rows.withColumn("__s", single).select(*rows.columns, "__s.*")


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order.

    The filter on the row number lets Spark cut every map task down to one row per key
    before the shuffle (WindowGroupLimit), so a key with very many rows is no hot spot.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


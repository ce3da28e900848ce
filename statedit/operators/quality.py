"""Keys, references, columns and names."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import null_safe_join
from ..schema import FOREIGN_KEYS
from ..scratch import dealt, settle, small_table

# Characters that make a column name unsafe.
RISKY_CHARACTERS = (".", "/", "-", " ")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows that share their key with another row.

    The repeated keys are computed right away. They are few in a sound table and then
    broadcast, so that the rows themselves are not shuffled.
    """
    repeated = settle(df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n"))
    return null_safe_join(df, repeated, keys, "left_semi")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return ``df``, or raise with a few examples when a key repeats. Runs a job."""
    examples = (
        df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).take(5)
    )
    if examples:
        raise ValueError(f"Duplicate rows on {list(keys)}, for example {[r.asDict() for r in examples]}")
    return df


def check_column_names(df: DataFrame, allow: bool = False) -> DataFrame:
    """Names with ``. / -`` or a space raise, or only warn when allowed."""
    risky = [c for c in df.columns if any(ch in c for ch in RISKY_CHARACTERS)]
    if risky:
        message = f"Column names with special characters ({', '.join(RISKY_CHARACTERS)}): {risky}"
        if not allow:
            raise ValueError(message)
        warnings.warn(message, stacklevel=2)
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns {missing}; found {df.columns}")
    return df


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Child rows whose key has no parent. A null in the key refers to nothing and passes."""
    complete = child
    for k in keys:
        complete = complete.where(F.col(k).isNotNull())
    return complete.join(parent.select(*keys), list(keys), "left_anti")


def reference_report(tables: dict[str, DataFrame], periods: Sequence[str] = ("period",)) -> DataFrame:
    """Number of orphans per declared foreign key among the tables given.

    Every table is read once, whatever the number of its references: its rows become keys
    tagged with the reference, which one shuffle brings together with those of the other
    side. They are counted behind it, for most keys of a task differ.
    """
    found = [(child, parent, [*periods, *keys]) for child, references in FOREIGN_KEYS.items() for parent, keys in references
             if child in tables and parent in tables]
    if not found:
        raise ValueError("No pair of tables with a declared reference was given.")

    def tagged(name: str, side: int) -> DataFrame | None:
        mine = [(i, keys) for i, (*pair, keys) in enumerate(found) if pair[side] == name]
        if not mine:
            return None
        keyed = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.col(k).cast("string") for k in keys]).alias("key")) for i, keys in mine])
        complete = F.filter(keyed, lambda x: ~F.exists(x["key"], lambda k: k.isNull()))
        rows = tables[name].select(F.inline(complete))
        return rows.select("i", "key", *[F.lit(int(side == s)).cast("bigint").alias(c) for s, c in ((0, "c"), (1, "p"))])

    sides = [t for name in dict.fromkeys(n for child, parent, _ in found for n in (child, parent)) for s in (0, 1)
             if (t := tagged(name, s)) is not None]
    keys = dealt(reduce(lambda a, b: a.unionByName(b), sides), "i", "key").groupBy("i", "key").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    lost = keys.where("p = 0").groupBy("i").agg(F.sum("c").alias("n"))
    names = small_table(next(iter(tables.values())).sparkSession, [(i, c, p) for i, (c, p, _) in enumerate(found)], "i int, child string, parent string")
    return names.join(lost, "i", "left").select("child", "parent", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def types_per_variable(
    types: DataFrame, like: DataFrame, *columns: str, table_name: str | None = None, periods: Sequence[str] = ("period",)
) -> tuple[DataFrame, list[str]]:
    """One row of metadata per variable, and the columns to join it on.

    Metadata is keyed by period, table and variable. ``table_name`` picks a table; without
    it, several tables must agree. The period takes part when ``like`` has one as well, else
    the periods must agree. Contradicting rows of one key fail the job.
    """
    if table_name is not None and "table_name" in types.columns:
        types = types.where(F.col("table_name") == table_name)
    keys = [c for c in (*periods, "variable") if c in types.columns and c in like.columns] or ["variable"]
    if "variable" not in keys:
        keys.append("variable")
    row = F.struct(*columns)
    one = types.groupBy(*keys).agg(F.min(row).alias("__low"), F.max(row).alias("__high"))
    agreed = F.when(F.col("__low").eqNullSafe(F.col("__high")), F.lit(True)).otherwise(F.raise_error(
        F.concat(F.lit("Contradicting metadata of variable "), F.coalesce("variable", F.lit("null")))).cast("boolean"))
    return one.where(agreed).select(*keys, *[F.col(f"__low.{c}").alias(c) for c in columns]), keys

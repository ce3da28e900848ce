"""Row and column selection, reshaping and field checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import NUMERIC_TYPES
from .quality import types_per_variable

# Heading texts that stay visible in a statement without amounts.
HEADINGS = (
    "", "Eiendeler", "Anleggsmidler", "Omløpsmidler", "Egenkapital og gjeld",
    "Egenkapital", "Langsiktig gjeld", "Kortsiktig gjeld", "Driftsinntekter",
    "Salgsinntekter", "Andre driftsinntekter ", "Driftskostnader", "Varekostnader",
    "Lønn og kostnader til ansatte", "Andre driftskostnader",
    "Finansposter og skattekostnad", "Finansinntekter", "Finanskostnader",
    "Skattekostnader",
)

# Accounts used by the petroleum sector only.
PETROLEUM_ACCOUNTS = ("3001", "3002", "3003", "3004", "3005", "3006", "3007", "3008", "3886")


def filter_by(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    return df.where(C.matches(filters))


def select_matching(df: DataFrame, fixed: Sequence[str], pattern: str) -> DataFrame:
    """Fixed columns plus every column whose whole name matches ``pattern``."""
    extra = [c for c in df.columns if c not in fixed and re.fullmatch(pattern, c)]
    return df.select(*fixed, *extra)


def keep_numeric_variables(
    obs: DataFrame, types: DataFrame, table_name: str | None = None, periods: Sequence[str] = ("period",)
) -> DataFrame:
    """Rows whose variable is numeric by the metadata of their own period and table.

    Metadata without period columns holds for all periods; contradicting rows fail the job.
    """
    one, keys = types_per_variable(types, obs, "datatype", table_name=table_name, periods=periods)
    numeric = one.where(F.col("datatype").isin(*NUMERIC_TYPES))
    return obs.join(numeric.select(*keys), keys, "left_semi")


def with_numeric_value(obs: DataFrame, default: int | None = None, out: str = "value") -> DataFrame:
    return obs.withColumn(out, C.coerce_numeric("value", default))


def filter_reported(statement: DataFrame, headings: Sequence[str] = HEADINGS) -> DataFrame:
    """Drop lines without any amount, but keep headings and ``SUM`` lines."""
    compare = F.col("compare_value").isNotNull() if "compare_value" in statement.columns else F.lit(False)
    text = F.col("description")
    return statement.where(
        F.col("value").isNotNull() | compare
        | F.coalesce(text.isin(*headings) | text.startswith("SUM"), F.lit(False))
    )


def exclude_codes(
    df: DataFrame,
    codes: Sequence[str] = PETROLEUM_ACCOUNTS,
    show: bool = False,
    sector_units: DataFrame | None = None,
) -> DataFrame:
    """Drop sector-specific accounts unless ``show``; units of the sector keep them."""
    if show:
        return df
    special = F.coalesce(F.col("account").isin(*codes), F.lit(False))
    if sector_units is None:
        return df.where(~special)
    members = sector_units.select("unit").distinct().withColumn("__member", F.lit(True))
    return (
        df.join(members, "unit", "left")
        .where(~special | F.col("__member").isNotNull())
        .drop("__member")
    )


def align_columns(
    df: DataFrame, rename: Mapping[str, str], expected: Sequence[str], default: Any = ""
) -> DataFrame:
    """Rename, add absent columns with a default, and keep the expected columns only."""
    df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    return df.select(*[F.col(c) if c in df.columns else F.lit(default).alias(c) for c in expected])


def drop_if_present(df: DataFrame, names: Sequence[str], suffix: str | None = "_right") -> DataFrame:
    doomed = [c for c in df.columns if c in names or (suffix and c.endswith(suffix))]
    return df.drop(*doomed)


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], positive_only: bool = False) -> DataFrame:
    """Wide to long with text values; optionally only values above zero."""
    if positive_only:
        long = df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values])
        kept = long.unpivot(list(ids), list(values), "variable", "value").where("value > 0")
        return kept.withColumn("value", F.col("value").cast("string"))
    text = df.select(*ids, *[F.col(v).cast("string").alias(v) for v in values])
    return text.unpivot(list(ids), list(values), "variable", "value")


def attribute(
    unit_info: DataFrame, variable: str, column: str,
    transform: Callable[[Column], Column] | None = None, keys: Sequence[str] = ("unit",),
) -> DataFrame:
    """One key of a key/value table as a column, one row per key."""
    value = F.max("value") if transform is None else F.max(transform(F.col("value")))
    return unit_info.where(F.col("variable") == variable).groupBy(*keys).agg(value.alias(column))


def attributes(unit_info: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("unit",)) -> DataFrame:
    """Several keys at once: one aggregate with explicit columns."""
    return unit_info.where(F.col("variable").isin(list(variables))).groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables]
    )


def field_report(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Counts per check and status. ``checks`` maps a name to a status column."""
    statuses = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), status.alias("status")) for name, status in checks.items()
    ])))
    return statuses.groupBy("check", "status").agg(F.count("*").alias("n"))


def failing_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Rows with at least one status other than ``ok``, with all their statuses."""
    flagged = df.select("*", *[status.alias(name) for name, status in checks.items()])
    bad = F.lit(False)
    for name in checks:
        bad = bad | (F.col(name) != "ok")
    return flagged.where(bad)


def datatype_report(obs: DataFrame, types: DataFrame, table_name: str | None = None) -> DataFrame:
    """Every value with its datatype status; values without metadata are ``ok``."""
    one, keys = types_per_variable(types, obs, "datatype", table_name=table_name)
    return obs.join(one, keys, "left").select(*obs.columns, "datatype").withColumn(
        "status", C.datatype_status("value", "datatype")
    )

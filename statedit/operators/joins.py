"""Joins between responses, periods, metadata and registers.

No join carries a broadcast hint: Catalyst and AQE broadcast a side when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffle (splitting skewed
keys) beyond it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import change, matches, percent_change
from ..functions.frames import null_safe_join, one_per_key
from ..functions.periods import BY_POSITION, YEARLY, Spine
from ..scratch import materialize
from .latest import latest_active
from .quality import require_columns, types_per_variable


def link_periods(receipts: DataFrame, current: Mapping[str, Any], previous: Mapping[str, Any]) -> DataFrame:
    """Latest active response now and before, by unit; new units have a null ``previous``."""
    now = latest_active(receipts, filters=current).select("unit", F.col("ref").alias("current"))
    then = latest_active(receipts, filters=previous).select("unit", F.col("ref").alias("previous"))
    return now.join(then, "unit", "left")


def establishments_of(enterprise: DataFrame, mapping: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Data of the establishments in ``mapping(unit, establishment_id)``."""
    ids = mapping.select(F.col("establishment_id"), F.col("unit").alias("enterprise"))
    joined = enterprise.join(ids, enterprise["unit"] == ids["establishment_id"]).drop("establishment_id")
    return joined.where(matches(filters))


def with_metadata(obs: DataFrame, types: DataFrame, table_name: str | None = None) -> DataFrame:
    """Row number and datatype of each variable in its period; unknown variables keep nulls."""
    one, keys = types_per_variable(types, obs, "rowno", "datatype", table_name=table_name)
    return obs.join(one, keys, "left").select(*obs.columns, "rowno", "datatype")


def hits_with_status(
    hits: DataFrame, receipts: DataFrame, control_id: str | None = None
) -> DataFrame:
    """Hits of active responses with the editing state of the response."""
    status = "status" if "status" in receipts.columns else "edited"
    active = receipts.where(F.col("active")).select("unit", "ref", status)
    rows = hits.where(F.col("hit"))
    if control_id is not None:
        rows = rows.where(F.col("control_id") == control_id)
    return (
        rows.select("unit", "ref", "control_id", "hit", "value")
        .join(active, ["unit", "ref"])
        .orderBy(status, "value")
    )


def describe_hits(
    hits: DataFrame, controls: DataFrame, ref: str | None = None,
    keys: Sequence[str] = ("control_id",), columns: Sequence[str] = ("description",),
) -> DataFrame:
    """Hits with the text of their control; ``ref`` narrows to one response."""
    texts = one_per_key(controls.select(*keys, *columns), keys, [F.col(columns[0])])
    rows = hits if ref is None else hits.where(F.col("ref") == ref)
    return rows.join(texts, list(keys), "left")


def describe_log(log: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All log rows with the account text where known, newest first per account."""
    return catalogue.select("account", "text").join(log, "account", "right").orderBy(
        "account", F.col("hist_id").desc()
    )


def diff_rows(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of both sides with ``new_only``, ``old_only`` or ``both``; nulls compare equal."""
    n = new.select(*keys).withColumn("__n", F.lit(1))
    o = old.select(*[F.col(k).alias(f"__o_{k}") for k in keys]).withColumn("__o", F.lit(1))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys])
    outcome = (
        F.when(F.col("__o").isNull(), "new_only").when(F.col("__n").isNull(), "old_only").otherwise("both")
    )
    return n.join(o, on, "full_outer").select(
        *[F.when(F.col("__n").isNull(), F.col(f"__o_{k}")).otherwise(F.col(k)).alias(k) for k in keys],
        outcome.alias("outcome"),
    )


def responses_in(obs: DataFrame, latest: DataFrame) -> DataFrame:
    return obs.join(latest.select("ref"), "ref", "left_semi")


def new_units(receipts: DataFrame, period: Any = None, spine: Spine = YEARLY, by: str = BY_POSITION) -> DataFrame:
    """Responses with ``hit`` where the unit sent nothing in the period before.

    With ``period`` only its responses are returned, otherwise those of every period.
    """
    keys = ["unit", *spine.columns]
    rows, sent = receipts, receipts.select(*keys)
    if period is not None:
        rows = rows.where(spine.is_in([spine.period(period)]))
        sent = sent.where(spine.is_in([spine.previous(period, by)]))
    seen = spine.following(sent, by).distinct().withColumn("__seen", F.lit(True))
    return rows.join(seen, keys, "left").select(*receipts.columns, F.col("__seen").isNull().alias("hit"))


def uncovered_pairs(tables: Sequence[str], forms: DataFrame, covered: DataFrame) -> DataFrame:
    """(table, form) pairs that no view covers."""
    names = F.array(*[F.lit(t) for t in tables])
    pairs = forms.select("form").distinct().select(F.explode(names).alias("table_name"), "form")
    return null_safe_join(pairs, covered.select("table_name", "form"), ["table_name", "form"], "left_anti")


def expand_scope(meta: DataFrame, scope: Mapping[str, Any]) -> DataFrame:
    """Every row of ``meta`` for every combination of the scope values."""
    for name, values in scope.items():
        values = values if isinstance(values, (list, tuple)) else [values]
        meta = meta.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return meta


def enrich_with_register(
    df: DataFrame, register: DataFrame, key: str = "unit", register_key: str = "unit"
) -> DataFrame:
    """Left join of register attributes, keys compared as text, one register row per key."""
    attributes = [c for c in register.columns if c != register_key]
    unique = one_per_key(
        register.withColumn("__key", F.col(register_key).cast("string")), ["__key"],
        [F.col(c).asc_nulls_last() for c in attributes],
    ).select("__key", *attributes)
    return df.withColumn("__key", F.col(key).cast("string")).join(unique, "__key", "left").drop("__key")


@dataclass(frozen=True)
class Section:
    """A named range of account numbers below a heading of a statement."""

    heading: str
    name: str
    start: int
    end: int


def section_columns(sections: Sequence[Section], account: Column) -> tuple[Column, Column]:
    """Heading and section of an account as one CASE each: no join for a handful of ranges."""
    number = account.try_cast("int")
    heading = name = F.lit(None).cast("string")
    for s in reversed(sections):
        inside = number.between(s.start, s.end)
        heading = F.when(inside, s.heading).otherwise(heading)
        name = F.when(inside, s.name).otherwise(name)
    return heading, name


def assign_section(ledger: DataFrame, sections: Sequence[Section]) -> DataFrame:
    """Add ``heading`` and ``section`` by account number; accounts in no range are dropped."""
    heading, name = section_columns(sections, F.col("account"))
    return ledger.withColumn("heading", heading).withColumn("section", name).where("section is not null")


def assign_section_by_table(ledger: DataFrame, sections: DataFrame, account: str = "account") -> DataFrame:
    """``assign_section`` with the sections as a table ``(heading, section, start, end)`` of any length.

    Every interval is cut into bins as wide as the intervals are on average, so there are at
    most about two bins per interval, and accounts meet them by an equi-join on the bin.
    Overlapping or inverted intervals fail when the operator is called; rows with a null
    bound hold nothing. Columns of the ledger that are called so are replaced.
    """
    bounds = sections.select(
        "heading", "section", F.col("start").cast("bigint").alias("__lo"), F.col("end").cast("bigint").alias("__hi")
    ).where("__lo is not null and __hi is not null")
    ahead = F.max("__hi").over(Window.orderBy("__lo", "__hi").rowsBetween(Window.unboundedPreceding, -1))
    checked = bounds.withColumn("__bad", (F.col("__lo") > F.col("__hi")) | F.coalesce(ahead >= F.col("__lo"), F.lit(False)))
    stored = materialize(checked)
    wrong = [tuple(r) for r in stored.where("__bad").select("section", "__lo", "__hi").take(3)]
    if wrong:
        raise ValueError(f"Sections overlap others or end before they start: {wrong}")
    width = max(1, int(stored.agg(F.avg(F.col("__hi") - F.col("__lo") + 1)).first()[0] or 1))
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width))
    bins = stored.select("heading", "section", "__lo", "__hi", F.explode(F.sequence(bin_of("__lo"), bin_of("__hi"))).alias("__bin"))
    rows = ledger.drop("heading", "section").withColumn("__no", F.col(account).try_cast("bigint"))
    inside = (F.col("__bin") == F.floor(F.col("__no") / F.lit(width))) & F.col("__no").between(F.col("__lo"), F.col("__hi"))
    return rows.join(bins, inside).drop("__no", "__bin", "__lo", "__hi")


def resolve_name(
    obs: DataFrame, mapping: DataFrame, match: str = "variable", result: str = "path",
    variable: str = "variable", keys: Sequence[str] = ("period", "form"),
) -> DataFrame:
    """Add the long ``name`` of each variable, or its short name where the mapping has none.

    ``match`` and ``result`` name the columns of the mapping; of several rows for one
    variable the first in text order counts.
    """
    long = mapping.groupBy(*keys, F.col(match).alias(variable)).agg(F.min(result).alias("__long"))
    return (
        obs.join(long, [*keys, variable], "left")
        .withColumn("name", F.coalesce("__long", variable)).drop("__long")
    )


def region_values(data: DataFrame, regions: DataFrame) -> DataFrame:
    """Values of known regions, with the attributes of the region."""
    require_columns(data, ["region", "value"])
    require_columns(regions, ["region"])
    return data.select("region", "value").join(regions, "region")


def year_change(
    obs: DataFrame, receipts: DataFrame, period: Any, spine: Spine = YEARLY, by: str = BY_POSITION,
) -> DataFrame:
    """Values of every response beside those of the unit's response one period earlier."""
    this, before = spine.period(period), spine.previous(period, by)
    latest = [latest_active(receipts.where(spine.is_in([p]))).select("unit", F.col("ref").alias(n))
              for p, n in ((this, "current"), (before, "previous"))]
    links = latest[0].join(latest[1], "unit", "left")
    sides = links.select("unit", F.inline(F.array(
        F.struct(F.lit(True).alias("now"), F.col("current").alias("ref")),
        F.struct(F.lit(False).alias("now"), F.col("previous").alias("ref")),
    ))).where("ref is not null")
    rows = obs.where(spine.is_in([this, before])).select("ref", "variable", "value").join(sides, "ref")
    pairs = rows.groupBy("unit", "variable").agg(
        F.max(F.when(F.col("now"), F.col("value"))).alias("value"),
        F.max(F.when(~F.col("now"), F.col("value"))).alias("previous_value"),
    )
    cur, prev = F.col("value").try_cast("double"), F.col("previous_value").try_cast("double")
    return pairs.select(
        "unit", "variable", "value", "previous_value",
        change(cur, prev).alias("diff"), percent_change(cur, prev).alias("pdiff"),
    )

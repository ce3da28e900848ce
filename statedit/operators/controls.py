"""Validation controls: metadata, catalogue, run, strict result checks, stored hits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import change, matches
from ..functions.frames import null_safe_join
from ..functions.periods import BY_POSITION, YEARLY, Spine
from ..scratch import materialize, small_table
from .aggregates import union_results
from .joins import expand_scope, new_units, responses_in
from .latest import duplicate_submissions, latest_active_per_period
from .upsert import insert_new

KINDS = ("H", "S", "I")
ORDERS = ("ASC", "DESC")


@dataclass
class ControlContext:
    """What a control function gets: the tables, the scope and the period columns."""

    tables: Mapping[str, DataFrame]
    scope: Mapping[str, Any]
    periods: Sequence[str] = ("period",)
    options: Mapping[str, Any] = field(default_factory=dict)
    #: Needed with several period columns: the ordered periods, and which one lies before.
    spine: Spine | None = None
    before: str = BY_POSITION

    def __post_init__(self) -> None:
        if self.spine is None:
            self.spine = Spine(tuple(self.periods)) if len(self.periods) == 1 else YEARLY
        else:
            self.periods = self.spine.columns

    def table(self, name: str) -> DataFrame:
        """The whole table; a control filters it to the scope itself, where it should."""
        return self.tables[name]

    def in_scope(self, name: str) -> DataFrame:
        df = self.tables[name]
        return df.where(matches({k: v for k, v in self.scope.items() if k in df.columns}))


ControlFunction = Callable[[ControlContext], DataFrame]


def control(
    id: str, kind: str, description: str, variables: list[str],
    sort_by: str | None = None, order: str | None = None, **extra: Any,
) -> Callable[[ControlFunction], ControlFunction]:
    """Attach the metadata of a control to a function ``(context) -> DataFrame``.

    ``kind`` is ``H`` (hard), ``S`` (soft) or ``I`` (informative).
    """
    if not isinstance(variables, list):
        raise TypeError(f"'variables' must be a list of strings, not {type(variables)}")
    if kind not in KINDS:
        raise ValueError(f"'kind' must be one of {KINDS}, not {kind!r}")
    order = "DESC" if order is None else order
    if order not in ORDERS:
        raise ValueError(f"'order' must be one of {ORDERS}, not {order!r}")
    meta = {
        "control_id": id, "kind": kind, "description": description, "variables": variables,
        "sort_by": sort_by or "", "sort_order": order, **extra,
    }

    def attach_meta(function: ControlFunction) -> ControlFunction:
        function.control_meta = meta
        return function

    return attach_meta


def find_controls(holder: Any) -> list[ControlFunction]:
    """Every control among the attributes of a module, class or object, by name."""
    found = [getattr(holder, n) for n in sorted(dir(holder)) if hasattr(getattr(holder, n), "control_meta")]
    if not found:
        raise ValueError("No controls found. Mark the functions with the 'control' decorator.")
    return found


def catalogue(spark: SparkSession, controls: Sequence[ControlFunction], scope: Mapping[str, Any]) -> DataFrame:
    """Catalogue rows: the metadata without ``variables``, for each combination of the scope."""
    rows = [{k: v for k, v in c.control_meta.items() if k != "variables"} for c in controls]
    names = list(dict.fromkeys(k for r in rows for k in r))
    extras = [n for n in names if any(not isinstance(r.get(n), (str, type(None))) for r in rows)]
    schema = ", ".join(f"`{n}` string" for n in names)
    data = [
        tuple(str(r[n]) if n in extras and r.get(n) is not None else r.get(n) for n in names) for r in rows
    ]
    return expand_scope(small_table(spark, data, schema), scope)


def register_controls(existing: DataFrame, controls: Sequence[ControlFunction], scope: Mapping[str, Any]) -> DataFrame:
    """The catalogue with the rows of ``controls``: one row per scope and control.

    A stored control gets the texts of the function as it is now; columns that only the
    catalogue has keep their values there.
    """
    new = catalogue(existing.sparkSession, controls, scope)
    new = new.select(*[F.col(c).cast(existing.schema[c].dataType) for c in new.columns if c in existing.columns])
    keys = [c for c in (*scope, "control_id") if c in new.columns]
    texts = [c for c in new.columns if c not in keys]
    now = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in texts], F.lit(True).alias("__known"))
    joined = null_safe_join(existing, now, keys, "left")
    updated = joined.select(*[
        F.when(F.col("__known"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in texts else F.col(c)
        for c in existing.columns
    ])
    return insert_new(updated, new, keys)


def _columns_ok(result: Any, meta: Mapping[str, Any], periods: Sequence[str]) -> DataFrame:
    name = meta["control_id"]
    if not isinstance(result, DataFrame):
        raise TypeError(f"Control {name!r} must return a DataFrame, not {type(result)}")
    if "control_id" not in result.columns:
        result = result.withColumn("control_id", F.lit(name))
    required = [*periods, "control_id", "unit", "ref", "hit"]
    missing = [c for c in required if c not in result.columns]
    if missing:
        raise ValueError(f"Missing required columns {missing} in the result of {name!r}")
    extra = sorted(set(result.columns) - {*required, "form", "value"})
    if extra:
        raise ValueError(f"Remove the extra columns {extra} from the result of {name!r}")
    return result


def _check(rows: DataFrame, names: Sequence[str], scope: Mapping[str, Any], periods: Sequence[str]) -> None:
    """One job and one scan of ``rows``, the results of all controls; raises on the first broken promise.

    ``__i`` tells the place of a row's control in ``names``. Results are reduced per
    (control, periods, unit, ref) and then per control, so only one row per control
    reaches the driver.
    """
    cols = list(scope)
    lacking = [c for c in cols if c not in rows.columns]
    if lacking:
        raise ValueError(f"Scope columns {lacking} are missing in the result of {', '.join(map(repr, names))}")
    checked = rows.select(
        F.array(*[F.lit(n) for n in names])[F.col("__i")].alias("__id"), *[F.col(p).alias(f"__p_{p}") for p in periods],
        "unit", "ref", F.col("control_id").cast("string").alias("__c"),
        *[F.col(c).cast("string").alias(f"__s_{c}") for c in cols],
    )
    watched = ["__c", *[f"__s_{c}" for c in cols]]
    per_key = checked.groupBy("__id", *[f"__p_{p}" for p in periods], "unit", "ref").agg(
        F.count("*").alias("n"),
        *[f(w).alias(f"{tag}{w}") for w in watched for tag, f in (("lo", F.min), ("hi", F.max), ("n", F.count))],
    )
    summary = per_key.groupBy("__id").agg(
        F.sum("n").alias("rows"), F.max("n").alias("worst"),
        *[g(f"{tag}{w}").alias(f"{tag}{w}") for w in watched for tag, g in (("lo", F.min), ("hi", F.max), ("n", F.sum))],
    )
    found = {r["__id"]: r for r in summary.collect()}
    expected = {f"__s_{c}": str(v[0] if isinstance(v, (list, tuple)) else v) for c, v in scope.items()}
    for name in names:
        row = found.get(name)
        if row is None:
            raise ValueError(f"Control {name!r} returned no rows; every response needs a row, hit or not")
        for w in watched:
            want = name if w == "__c" else expected[w]
            if row[f"lo{w}"] != row[f"hi{w}"] or row[f"n{w}"] != row["rows"]:
                raise ValueError(
                    f"Result of {name!r} has more than one value in {w[2:]!r}: "
                    f"{row[f'lo{w}']!r} to {row[f'hi{w}']!r}, expected only {want!r}"
                )
            if row[f"lo{w}"] != want:
                raise ValueError(f"Result of {name!r} has {row[f'lo{w}']!r} in {w[2:]!r}, expected {want!r}")
        if row["worst"] > 1:
            raise ValueError(f"Result of {name!r} has duplicate rows per (periods, unit, ref)")


def validate_result(result: DataFrame, meta: Mapping[str, Any], scope: Mapping[str, Any], periods: Sequence[str] = ("period",)) -> DataFrame:
    """Return the result with ``control_id`` filled, or raise. Never repairs. Runs a job.

    Controls that forgot to filter on the scope would report false hits, so a result
    with any other scope value is an error and not filtered here.
    """
    result = _columns_ok(result, meta, periods)
    _check(result.withColumn("__i", F.lit(0)), [meta["control_id"]], scope, periods)
    return result


def run_controls(controls: Iterable[ControlFunction], context: ControlContext) -> DataFrame:
    """Run all controls, store their union once, check it in one job, and return it."""
    results = [(c.control_meta, _columns_ok(c(context), c.control_meta, context.periods)) for c in controls]
    wanted = ["form", "value"]
    tagged = []
    for i, (_, df) in enumerate(results):
        optional = [c for c in wanted if c in df.columns]
        tagged.append(df.select(
            *context.periods, "control_id", "unit", "ref", "hit", *optional, F.lit(i).alias("__i")
        ))
    # The results are used twice (check and sync): compute the controls only once.
    stored = materialize(union_results(tagged))
    _check(stored, [meta["control_id"] for meta, _ in results], context.scope, context.periods)
    return stored.drop("__i")


def sync_hits(existing: DataFrame, results: DataFrame, scope_cols: Sequence[str]) -> DataFrame:
    """Stored hits after a run, with ``outcome`` per row.

    ``insert`` for a new key, ``update`` where hit or value changed, ``keep`` where they
    did not, and ``untouched`` for stored rows the run did not return. The key is the
    scope columns, control, unit and ref.
    """
    keys = [*scope_cols, "control_id", "unit", "ref"]
    has_value = "value" in results.columns
    new = results.select(
        *[F.col(k).alias(f"__n_{k}") for k in keys], F.col("hit").alias("__n_hit"),
        (F.col("value").cast(existing.schema["value"].dataType) if has_value else F.lit(None)).alias("__n_value"),
        *[F.col(c).alias(f"__n_{c}") for c in existing.columns
          if c in results.columns and c not in (*keys, "hit", "value")],
        F.lit(True).alias("__new"),
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys])
    joined = existing.withColumn("__old", F.lit(True)).join(new, on, "full_outer")
    same = F.col("hit").eqNullSafe(F.col("__n_hit"))
    if has_value:
        same = same & F.col("value").eqNullSafe(F.col("__n_value"))
    outcome = (
        F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "untouched")
        .when(same, "keep").otherwise("update")
    )

    def pick(c: str):
        if c == "hit" or (c == "value" and has_value):
            return F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c)
        if f"__n_{c}" in new.columns:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__n_{c}")).alias(c)
        return F.col(c)

    return joined.select(*[pick(c) for c in existing.columns], outcome.alias("outcome"))


# --- built-in controls ---------------------------------------------------------------


@control("new_unit", "I", "Unit is new this period", ["unit"], order="ASC")
def new_unit(ctx: ControlContext) -> DataFrame:
    """Hit where the unit sent nothing one period earlier."""
    rows = new_units(ctx.table("receipts"), ctx.scope, ctx.spine, ctx.before)
    rest = {k: v for k, v in ctx.scope.items() if k not in ctx.periods}
    return rows.where(matches(rest)).select(*ctx.periods, "form", "unit", "ref", "hit", F.lit(0).alias("value"))


@control("large_change", "S", "Large change from the period before", ["value"], order="DESC")
def large_change(ctx: ControlContext) -> DataFrame:
    """Hit where a variable changed by more than ``limit`` per cent (100 by default).

    Only units with both values above zero are judged. ``value`` is the change in per
    cent, truncated. Without the option ``variable`` every variable is judged, and a
    unit's row shows its largest change.
    """
    spine = ctx.spine
    this, before = spine.period(ctx.scope), spine.previous(ctx.scope, ctx.before)
    variable, limit = ctx.options.get("variable"), ctx.options.get("limit", 100)
    rest = {k: v for k, v in ctx.scope.items() if k not in ctx.periods}
    chosen = rest if variable is None else {**rest, "variable": variable}
    obs = ctx.table("observations").where(spine.is_in([this, before])).where(matches(chosen))
    receipts = ctx.table("receipts").where(spine.is_in([this, before]))
    latest = latest_active_per_period(receipts, filters=rest, periods=spine.columns)
    keys = ["unit", "variable"] if variable is None else ["unit"]
    narrow = obs.select(*spine.columns, "form", "ref", *keys, F.col("value").try_cast("double").alias("__v"))
    # A unit has one response per period now, so one aggregate sets them side by side.
    now, v = spine.is_in([this]), F.col("__v")
    pairs = responses_in(narrow, latest).groupBy(*keys).agg(
        F.max(F.when(now, F.struct("form", "ref"))).alias("__r"),
        F.max(F.when(now, v)).alias("__cur"), F.max(F.when(~now, v)).alias("__prev"),
    )
    # Filters may be reordered, so the division must stand a zero that a filter excludes.
    percent = F.try_divide(change("__cur", "__prev"), F.col("__prev")) * 100
    judged = pairs.where("__cur > 0 and __prev > 0").select("unit", "__r", percent.alias("__pct"))
    if variable is None:
        judged = judged.groupBy("unit").agg(
            F.max("__r").alias("__r"), F.max(F.struct(F.abs("__pct").alias("size"), "__pct"))["__pct"].alias("__pct")
        )
    return judged.select(
        *[F.lit(v).alias(c) for c, v in spine.filters(this).items()], "__r.form", "unit", "__r.ref", (F.abs("__pct") > limit).alias("hit"),
        F.col("__pct").try_cast("int").alias("value"),
    )


@control("duplicate_submission", "I", "Unit has sent more than one response", ["unit"], order="ASC")
def duplicate_submission(ctx: ControlContext) -> DataFrame:
    rows = duplicate_submissions(ctx.table("receipts"), ctx.scope)
    return rows.select(*ctx.periods, "form", "unit", "ref", "hit", F.lit(0).alias("value")).distinct()

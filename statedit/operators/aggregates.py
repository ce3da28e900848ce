"""Totals, shares, distributions, receipt monitoring, sorts and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import coerce_numeric, exact_amount, matches, percent_change, total_type
from ..functions.frames import attach, one_per_key
from ..functions.ordered import exact_quantiles, rank_within, running_total
from ..functions.periods import BY_POSITION, YEARLY, Spine
from ..schema import UNTREATED
from ..scratch import materialize, settle
from .filters import attribute, keep_numeric_variables
from .joins import Section, responses_in, section_columns
from .latest import latest_active_per_period

# Sections of the balance sheet and the income statement.
BALANCE_SECTIONS = (
    Section("eiendeler", "anleggsmidler", 1000, 1399),
    Section("eiendeler", "omløpsmidler", 1400, 1999),
    Section("egenkapital_og_gjeld", "egenkapital", 2000, 2099),
    Section("egenkapital_og_gjeld", "langsiktig gjeld", 2100, 2299),
    Section("egenkapital_og_gjeld", "kortsiktig gjeld", 2300, 2999),
)
INCOME_SECTIONS = (
    Section("driftsinntekter", "salgsinntekter", 3000, 3399),
    Section("driftsinntekter", "andre driftsinntekter", 3400, 3999),
    Section("driftskostnader", "varekostnader", 4000, 4999),
    Section("driftskostnader", "lønn og kostnader til ansatte", 5000, 5999),
    Section("driftskostnader", "andre driftskostnader", 6000, 7999),
    Section("finansposter og skattekostnad", "finansinntekter", 8000, 8099),
    Section("finansposter og skattekostnad", "finanskostnader", 8100, 8299),
    Section("finansposter og skattekostnad", "skattekostnader", 8300, 8999),
)

# Contra accounts, counted with the opposite sign.
CONTRA_ACCOUNTS = ("1296", "1298", "1299", "2010", "2080", "2095", "3300", "4995", "6998", "7099")

# The yearly result is income - cost + financial income - financial cost - tax.
RESULT_TERMS = {
    "salgsinntekter": 1,
    "andre driftsinntekter": 1,
    "varekostnader": -1,
    "lønn og kostnader til ansatte": -1,
    "andre driftskostnader": -1,
    "finansinntekter": 1,
    "finanskostnader": -1,
    "skattekostnader": -1,
}
RESULT_NAME = "årsresultat"


def period_totals(
    obs: DataFrame, receipts: DataFrame, types: DataFrame, period: Any, form: str | None = None,
    spine: Spine = YEARLY, by: str = BY_POSITION, table_name: str | None = None,
) -> DataFrame:
    """Totals per numeric variable, this period and the one before, with the change.

    Only the latest active response of each unit and period counts. Columns are the
    variable, one total per period named after it, ``diff`` and ``pdiff``. ``spine`` has
    the period columns and says, with ``by``, which period lies before; where none does,
    its total is null and named ``previous``.
    """
    this, before = spine.period(period), spine.previous(period, by)
    names = {this: spine.label(this), before: "previous" if before is None else spine.label(before)}
    wanted = spine.is_in([this, before])
    latest = latest_active_per_period(receipts.where(wanted), form, periods=spine.columns)
    # Narrow rows before the semi join: it is the one shuffle of the observations.
    numeric = keep_numeric_variables(obs.where(wanted), types, table_name, spine.columns)
    narrow = numeric.select("ref", *spine.columns, "variable", coerce_numeric("value").alias("__v"))
    values = responses_in(narrow, latest)
    totals = values.groupBy("variable").agg(
        *[F.sum(F.when(spine.is_in([p]), F.col("__v"))).alias(n) for p, n in names.items()]
    )
    cur, prev = (F.col(f"`{n}`") for n in names.values())
    return totals.select(
        "variable", cur, prev, (cur - prev).alias("diff"),
        F.round(percent_change(cur, prev, missing_base=1), 2).alias("pdiff"),
    )


def contributions(obs: DataFrame, variable: str, k: int | None = 10) -> DataFrame:
    """Each unit's share of the grand total in per cent, largest first."""
    values = obs.where((F.col("variable") == variable) & F.col("value").isNotNull())
    per_unit = values.groupBy("unit").agg(F.sum(coerce_numeric("value")).alias("__v"))
    total = per_unit.agg(F.sum("__v").alias("__t"))
    share = F.round(F.try_divide(F.col("__v"), F.col("__t")) * 100, 2)
    ranked = attach(per_unit, total, []).orderBy(F.desc("__v"), "unit")
    return (ranked.limit(k) if k else ranked).select("unit", share.alias("share"))


def totals_by_variable(obs: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    return obs.where(matches(filters)).groupBy("variable").agg(
        F.sum(coerce_numeric("value")).alias("total")
    )


def totals_by_region(obs: DataFrame, municipalities: DataFrame, variable: str) -> DataFrame:
    """Totals for all, per county and per municipality in one pass.

    ``municipalities(unit, municipality)`` has one row per unit. ``level`` tells which
    columns are rolled up, so that a missing region is not taken for a total.
    """
    values = obs.where(F.col("variable") == variable).select("unit", coerce_numeric("value").alias("__v"))
    # Reduce to one row per unit before the join: the join then has no hot key.
    per_unit = values.groupBy("unit").agg(F.sum("__v").alias("__v"))
    rows = per_unit.join(municipalities, "unit", "left").withColumn("county", F.left("municipality", F.lit(2)))
    totals = rows.rollup("county", "municipality").agg(
        F.sum("__v").alias("total"), F.grouping_id().alias("__g")
    )
    level = F.element_at(F.array(F.lit("municipality"), F.lit("county"), F.lit(None), F.lit("all")), F.col("__g").cast("int") + 1)
    return totals.select("county", "municipality", "total", level.alias("level"))


def units_in_region(obs: DataFrame, municipalities: DataFrame, variable: str, municipality: str | None = None) -> DataFrame:
    """Last step of the drill-down: the values of the units of a municipality (or of all)."""
    members = municipalities if municipality is None else municipalities.where(F.col("municipality") == municipality)
    return obs.where(F.col("variable") == variable).withColumn("value", coerce_numeric("value")).join(members, "unit")


def wide_statement(ledger: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """One row per submission, one summed column per known account."""
    amount = exact_amount(ledger)
    return ledger.groupBy("seq").agg(
        *[F.sum(F.when(F.col("account") == a, amount)).alias(a) for a in accounts]
    )


def variables_side_by_side(obs: DataFrame, variables: Sequence[str], ref: str | None = None) -> DataFrame:
    """Mean of each chosen variable per unit, flagging the unit of one response."""
    rows = obs.where(F.col("variable").isin(list(variables)))
    v = coerce_numeric("value")
    chosen = F.max(F.col("ref") == ref) if ref is not None else F.lit(False)
    return rows.groupBy("unit").agg(
        *[F.avg(F.when(F.col("variable") == name, v)).alias(name) for name in variables],
        chosen.alias("highlight"),
    )


def control_overview(
    controls: DataFrame, hits: DataFrame, receipts: DataFrame, keys: Sequence[str] | None = None,
    periods: Sequence[str] = ("period",),
) -> DataFrame:
    """Per row of the catalogue: hits, and hits on active responses nobody has worked on yet.

    ``keys`` is the catalogue's key; by default what both sides have of period, form and
    control, so that a control's hits of one period do not count in another.
    """
    if keys is None:
        keys = [c for c in (*periods, "form", "control_id") if c in controls.columns and c in hits.columns]
    if "status" in receipts.columns:
        untreated = F.col("status") == UNTREATED
    else:
        untreated = F.col("edited") == F.lit(False)
    open_refs = receipts.where(F.col("active") & untreated).select("unit", "ref").distinct()
    fired = hits.where(F.col("hit")).select(*keys, "unit", "ref")
    counts = fired.join(open_refs.withColumn("__open", F.lit(1)), ["unit", "ref"], "left").groupBy(*keys).agg(
        F.count("*").alias("n_hits"), F.count("__open").alias("n_untreated")
    )
    zero = F.lit(0).cast("bigint")
    return (
        controls.join(counts, list(keys), "left")
        .withColumn("n_hits", F.coalesce("n_hits", zero))
        .withColumn("n_untreated", F.coalesce("n_untreated", zero))
    )


def daily_receipts(receipts: DataFrame) -> DataFrame:
    return (
        receipts.where(F.col("received_at").isNotNull())
        .groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("n"))
    )


def cumulative_receipts(receipts: DataFrame, units: DataFrame) -> DataFrame:
    """Units by the time of their latest receipt, running total, and share of the frame.

    Most of a survey may come in on the last day, so the running total is cut by the
    receipts themselves and not by the calendar.
    """
    latest = receipts.where(F.col("received_at").isNotNull()).groupBy("unit").agg(
        F.max("received_at").alias("received_at")
    )
    per_time = latest.groupBy("received_at").agg(F.count("*").alias("n"))
    frame = units.agg(F.count("*").alias("n_frame"))
    zoneless = dict(per_time.dtypes)["received_at"] == "timestamp_ntz"
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = (
        F.timestamp_diff("MICROSECOND", epoch, "received_at") if zoneless else F.unix_micros("received_at")
    )
    run = running_total(per_time, [], micros, "n", "cumulative")
    return attach(run, frame, []).select(
        "received_at", "n", "cumulative", "n_frame",
        F.try_divide(F.col("cumulative") * 100.0, F.col("n_frame")).alias("share"),
    )


def section_totals(
    ledger: DataFrame, sections: Sequence[Section], contra: Sequence[str] = CONTRA_ACCOUNTS,
    result_terms: Mapping[str, int] | None = None, keys: Sequence[str] = ("seq",),
) -> DataFrame:
    """Signed sums per section, per heading and for the derived result.

    One aggregate per submission over all sections, in exact decimals; the lines are
    unfolded afterwards. A section without accounts counts as 0, and a zero line is shown
    as null.
    """
    _, name = section_columns(sections, F.col("account"))
    amount = exact_amount(ledger)
    amount = F.coalesce(amount, F.lit(0))
    signed = F.when(F.col("account").isin(list(contra)), -amount).otherwise(amount)
    rows = ledger.select(*keys, name.alias("__s"), signed.alias("__v"))
    sums = rows.groupBy(*keys).agg(
        F.count("__s").alias("__n"),
        *[
            F.coalesce(F.sum(F.when(F.col("__s") == s.name, F.col("__v"))), F.lit(0)).alias(f"__{i}")
            for i, s in enumerate(sections)
        ],
    ).where("__n > 0")
    plus = lambda cols: reduce(lambda a, b: a + b, cols)
    column = {s.name: F.col(f"__{i}") for i, s in enumerate(sections)}
    headings = list(dict.fromkeys(s.heading for s in sections))
    lines = [("section", s.heading, s.name, column[s.name]) for s in sections]
    lines += [
        ("heading", h, h, plus([column[s.name] for s in sections if s.heading == h])) for h in headings
    ]
    if result_terms:
        total = plus([column[n] * sign for n, sign in result_terms.items()])
        lines.append(("result", RESULT_NAME, RESULT_NAME, total))
    unfolded = F.inline(F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.lit(h).alias("heading"), F.lit(n).alias("section"),
            F.when(v != 0, v.cast(total_type(ledger))).alias("amount"),
        )
        for kind, h, n, v in lines
    ]))
    return sums.select(*keys, unfolded)


def hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("control_id", "hit").agg(F.count("*").alias("n"))


def _fences(obs: DataFrame, variable: str | None, whisker: float) -> tuple[DataFrame, DataFrame]:
    rows = obs.where(F.col("value").isNotNull())
    if variable is not None:
        rows = rows.where(F.col("variable") == variable)
    # Both the quantiles and the points come from the rows as they are stored here.
    rows = materialize(rows.withColumn("value", coerce_numeric("value")).where("value is not null"))
    q = settle(exact_quantiles(
        rows, ["variable"], "value",
        {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}, stored=True,
    ))
    iqr = F.col("q3") - F.col("q1")
    return rows, q.withColumn("lower", F.col("q1") - whisker * iqr).withColumn("upper", F.col("q3") + whisker * iqr)


def distribution(obs: DataFrame, variable: str | None = None, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per variable: count, extremes, quartiles and fences.

    Computed right away, one row per variable.
    """
    return _fences(obs, variable, whisker)[1]


def distribution_points(obs: DataFrame, variable: str | None = None, whisker: float = 1.5) -> DataFrame:
    """Every observation with a flag for lying outside its variable's fences."""
    rows, fences = _fences(obs, variable, whisker)
    outside = ~F.col("value").between(F.col("lower"), F.col("upper"))
    return attach(rows, fences.select("variable", "lower", "upper"), ["variable"]).withColumn("outlier", outside).drop("lower", "upper")


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the extremes; the last bin is closed."""
    rows = df.select(F.col(x).cast("double").alias("x")).where("x is not null")
    edges = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    raw = F.floor(F.try_divide(F.col("x") - F.col("lo"), width))
    bin_no = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))
    counts = attach(rows, edges, []).select("lo", width.alias("width"), bin_no.cast("int").alias("bin"))
    return counts.groupBy("lo", "width", "bin").agg(F.count("*").alias("n")).select(
        "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("from_x"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("to_x"), "n",
    )


def top_k(df: DataFrame, k: int = 5, by: str = "value", tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(k)


def rank_hits(hits: DataFrame, controls: DataFrame, absolute: bool = False) -> DataFrame:
    """Hits ranked within their control by its own sort order (``ASC`` or ``DESC``)."""
    orders = one_per_key(controls.select("control_id", "sort_order"), ["control_id"], [F.col("sort_order")])
    rows = hits.where(F.col("hit")).join(orders, "control_id", "left")
    v = F.abs("value") if absolute else F.col("value")
    key = F.when(F.col("sort_order") == "ASC", v).otherwise(-v)
    return rank_within(rows, ["control_id"], key, "rank")


def top_hits(hits: DataFrame, controls: DataFrame, k: int, tie: Sequence[str] = ("unit", "ref")) -> DataFrame:
    """The first ``k`` hits of every control in its own sort order."""
    orders = one_per_key(controls.select("control_id", "sort_order"), ["control_id"], [F.col("sort_order")])
    rows = hits.where(F.col("hit")).join(orders, "control_id", "left")
    key = F.when(F.col("sort_order") == "ASC", F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("control_id").orderBy(key.asc_nulls_last(), *tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pin_first(df: DataFrame, column: str, value: Any, *then: str | Column) -> DataFrame:
    """Rows with the chosen value first, the rest in order."""
    return df.orderBy(F.when(F.col(column) == value, 0).otherwise(1), *(then or (column,)))


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def forms_of_unit(receipts: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Distinct forms per unit and period."""
    return receipts.where(matches(filters)).select("period", "unit", "form").distinct()


def available_periods(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("period").isNotNull()).select("unit", "period").distinct()


def forms_in_frame(units: DataFrame) -> DataFrame:
    """Comma-separated form lists of the frame as distinct forms."""
    return (
        units.where(F.col("form").isNotNull())
        .select(F.explode(F.split("form", ",")).alias("form"))
        .select(F.trim("form").alias("form")).distinct()
    )


def regional_attributes(unit_info: DataFrame) -> DataFrame:
    """``(unit, municipality)`` from the key/value table."""
    return attribute(unit_info, "municipality", "municipality")


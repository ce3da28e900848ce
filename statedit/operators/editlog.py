"""Audited edits: building, replaying and reporting a change log, and editing tables by batch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import datatype_status, local_seconds
from ..functions.frames import null_safe_join
from ..functions.ordered import UPTO
from ..schema import INITIAL_LOAD, IN_PROGRESS, UNTREATED
from ..scratch import materialize
from .quality import check_column_names, require_unique, types_per_variable

# How a missing value is written in a log, and an export not done yet.
NONE = "None"
TARGET_PLACEHOLDER = "data_target_placeholder"

# Reasons for a change.
REASONS = ("REVIEW", "OWNER", "OTHER_SOURCE", "MARGINAL_UNIT", "DUPLICATE", "OTHER")

LOG_SCHEMA = (
    "statistics_name string, data_source array<string>, data_target string, data_period string, "
    "variable_name string, change_event string, change_event_reason string, "
    "change_datetime timestamp, changed_by string, data_change_type string, change_comment string, "
    "change_details struct<detail_type: string, "
    "unit_id: array<struct<unit_id_variable: string, unit_id_value: string>>, "
    "old_value: array<struct<variable_name: string, value: string>>, "
    "new_value: array<struct<variable_name: string, value: string>>>"
)


def _guard(ok: Column, message: str, value: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def build_log(edits: DataFrame, id_vars: Sequence[str], meta: Mapping[str, Any], row: str = "data") -> DataFrame:
    """Log rows for cell edits.

    ``edits`` has ``colId, oldValue, value, timestamp`` (epoch ms), ``reason``,
    ``comment`` and the edited row, as a struct named ``row`` or as plain columns.
    ``meta`` gives ``statistics_name, data_source, data_period, changed_by``.
    A ``seq`` column orders edits of the same time. A missing comment or an unknown
    reason fails the job.
    """
    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(NONE))

    def id_value(v: str) -> Column:
        return F.col(f"{row}.{v}") if row in edits.columns else F.col(v)

    def value(c: str) -> Column:
        return F.array(F.struct(F.col("colId").alias("variable_name"), text(F.col(c)).alias("value")))

    comment = F.regexp_replace("comment", "\n", "")
    return edits.select(
        F.lit(meta.get("statistics_name")).cast("string").alias("statistics_name"),
        F.array(F.lit(meta["data_source"])).alias("data_source"),
        F.lit(TARGET_PLACEHOLDER).alias("data_target"),
        F.lit(meta.get("data_period")).cast("string").alias("data_period"),
        F.col("colId").alias("variable_name"),
        F.lit("M").alias("change_event"),
        _guard(F.col("reason").isin(*REASONS), "Unknown reason for a change.", F.col("reason")).alias("change_event_reason"),
        F.timestamp_millis("timestamp").alias("change_datetime"),
        F.lit(meta.get("changed_by")).cast("string").alias("changed_by"),
        F.lit("UPD").alias("data_change_type"),
        _guard(F.trim("comment") != "", "A change needs a comment.", comment).alias("change_comment"),
        F.struct(
            F.lit("unit").alias("detail_type"),
            F.array(*[
                F.struct(F.lit(v).alias("unit_id_variable"), text(id_value(v)).alias("unit_id_value"))
                for v in id_vars
            ]).alias("unit_id"),
            value("oldValue").alias("old_value"),
            value("value").alias("new_value"),
        ).alias("change_details"),
        *(["seq"] if "seq" in edits.columns else []),
    )


def _typed_text(raw: Column, variable: Column, base: DataFrame, names: Sequence[str]) -> Column:
    """Text as the variable's column would print it; null when it cannot be read."""
    cases = F.lit(None).cast("string")
    for n in reversed(names):
        cases = F.when(variable == n, raw.try_cast(base.schema[n].dataType).cast("string")).otherwise(cases)
    return cases


def _state_columns(df: DataFrame, by: Sequence[str], order: Sequence[str], sets: str, value: str) -> DataFrame:
    """State of a cell after each row, when rows are applied along ``order``.

    A row either sets the cell (``sets``) or fills it only while it is null. So the
    state is the first non-null value since the last setting row. ``__seg`` > 0 tells
    that a setting row has been seen; before that ``__after`` is only a candidate for a
    cell that came in as null. ``__last`` marks the last row of a cell.
    """
    along = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("__seg", F.sum(F.col(sets).cast("int")).over(along.rowsBetween(*UPTO)))
    inside = Window.partitionBy(*by, "__seg").orderBy(*order).rowsBetween(*UPTO)
    df = df.withColumn("__after", F.first(value, ignorenulls=True).over(inside))
    # __seg grows along the order, so this window is already sorted by the one before.
    again = Window.partitionBy(*by).orderBy("__seg", *order)
    return df.withColumns({
        "__before": F.lag(F.struct("__seg", "__after")).over(again), "__last": F.lead(F.lit(True)).over(again).isNull()})


def _carry(state: Column, local_set: Column, local: Column) -> Column:
    return F.when(F.coalesce(local_set, F.lit(False)), local).otherwise(F.coalesce(state, local))


def replay_log(
    base: DataFrame, log: DataFrame, id_vars: Sequence[str], variables: Sequence[str] | None = None,
    chunk: str = "hour",
) -> tuple[DataFrame, DataFrame]:
    """Replay a change log: ``(edited, problems)``.

    A log row may change several cells; they apply in their order in the row. Edits apply in order of ``change_datetime`` and then ``seq``. An edit takes effect
    when its old value equals the cell; a logged old value of ``None`` fills a null cell
    and does nothing otherwise. ``problems`` lists edits that cannot be applied
    (``unit_not_found``, ``unit_not_unique``, ``stale_old_value``, ``bad_value``,
    ``unknown_variable``, ``uneven_cells`` where old and new values do not pair up); ``edited`` is only meaningful when it is empty.

    A row is found by the ids that the log row itself names, one or more of ``id_vars``;
    for every such set of names the base is searched once.

    The edits of a cell are never collected. They are folded by window within time
    chunks, and the chunks by a second window, so a cell with very many edits is spread
    over tasks. The log is worked out right away.
    """
    id_vars = list(id_vars)
    names = [c for c in base.columns if c not in id_vars] if variables is None else list(variables)
    names = [n for n in names if n in base.columns and n not in id_vars]
    if not names:
        raise ValueError("No column that the log may change.")
    keys = [f"__k_{v}" for v in id_vars]
    cell = [*keys, "variable"]
    cells = log if "__cell" in log.columns else log_cells(log)
    raw = cells.select(
        *[F.try_element_at("ids", F.lit(v)).alias(k) for v, k in zip(id_vars, keys)], F.map_keys("ids").alias("__named"),
        "variable", "t", "pos", "old_raw", "new_raw", "uneven",
    )
    keyed = base.select("*", *[F.col(v).cast("string").alias(k) for v, k in zip(id_vars, keys)])
    raw = _with_whole_keys(raw, keyed, id_vars, keys)
    typed = raw.select(
        "*",
        _typed_text(F.nullif("old_raw", F.lit(NONE)), F.col("variable"), base, names).alias("old"),
        _typed_text(F.nullif("new_raw", F.lit(NONE)), F.col("variable"), base, names).alias("new"),
        F.coalesce(F.col("old_raw") != NONE, F.lit(False)).alias("sets"),
        F.date_trunc(chunk, "t").alias("chunk"),
    )
    # The log is used by every step below and is small beside the base: work it out once.
    steps = materialize(_state_columns(typed, [*cell, "chunk"], ["t", "pos"], "sets", "new"))

    chunks = steps.where("__last").select(*cell, "chunk", (F.col("__seg") > 0).alias("s"), F.col("__after").alias("v"))
    folded = materialize(_state_columns(chunks, cell, ["chunk"], "s", "v"))
    final = folded.groupBy(*cell).agg(
        F.max_by(F.struct((F.col("__seg") > 0).alias("s"), F.col("__after").alias("v")), "chunk").alias("__f")
    )

    edited = _apply_final(base, keyed, final, names, keys)
    problems = _problems(keyed, steps, folded, names, keys, cell)
    return edited, problems.select(
        *[F.col(k).alias(v) for k, v in zip(keys, id_vars)], "variable", "change_datetime", "problem",
        "expected", "found",
    )


def log_cells(log: DataFrame) -> DataFrame:
    """The cells that a log changes, one row each, in one pass over the log: worked out and stored."""
    details = F.col("change_details")
    ids = F.map_from_entries(F.transform(
        details["unit_id"], lambda u: F.struct(u["unit_id_variable"], u["unit_id_value"])
    ))
    seq = F.col("seq") if "seq" in log.columns else F.monotonically_increasing_id()
    rows = log.select(
        ids.alias("ids"), F.col("change_datetime").alias("t"), seq.alias("seq"), details["old_value"].alias("olds"), details["new_value"].alias("news"),
    )
    paired = rows.select("ids", "t", "seq", F.posexplode_outer(F.arrays_zip("olds", "news")).alias("cell_no", "c"))
    old, new = F.col("c.olds"), F.col("c.news")
    return materialize(paired.select(
        "ids", F.coalesce(old["variable_name"], new["variable_name"]).alias("variable"), "t",
        F.struct("seq", "cell_no").alias("pos"), old["value"].alias("old_raw"), new["value"].alias("new_raw"),
        (~F.coalesce(old["variable_name"] == new["variable_name"], F.lit(False))).alias("uneven"), F.lit(True).alias("__cell"),
    ))


#: Sets of id names that a log may use; more are no log of one table.
MOST_SIGNATURES = 64


def _with_whole_keys(raw: DataFrame, keyed: DataFrame, id_vars: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Log cells with all keys of their base row, and ``__lost`` where there is not exactly one.

    Rows that name all ids are taken as they are. The others are grouped by the names they
    use, and each group's ids meet the base in one join.
    """
    used = raw.select(F.array_sort(F.array_intersect("__named", F.array(*[F.lit(v) for v in id_vars]))).alias("s"))
    found = [tuple(r.s) for r in used.distinct().limit(MOST_SIGNATURES + 1).collect() if r.s is not None]
    if len(found) > MOST_SIGNATURES:
        raise ValueError(f"The log names its units by more than {MOST_SIGNATURES} sets of ids.")
    whole = tuple(sorted(id_vars))
    if all(s == whole for s in found):
        return raw.drop("__named").withColumn("__lost", F.lit(None).cast("string"))
    out = raw.where(F.size(F.array_except(F.array(*[F.lit(v) for v in id_vars]), "__named")) == 0).withColumn(
        "__lost", F.lit(None).cast("string"))
    for s in found:
        if s == whole:
            continue
        names = F.array(*[F.lit(v) for v in s]) if s else F.array().cast("array<string>")
        own = F.array_sort(F.array_intersect("__named", F.array(*[F.lit(v) for v in id_vars])))
        rows = raw.where(own == names)
        by = [k for v, k in zip(id_vars, keys) if v in s]
        if not by:
            out = out.unionByName(rows.withColumn("__lost", F.lit("unit_not_found")))
            continue
        asked = rows.select(*by).distinct()
        places = keyed.join(asked, by, "left_semi").groupBy(*by).agg(
            F.count("*").alias("__n"), F.min(F.struct(*keys)).alias("__place"))
        located = rows.join(places.withColumnsRenamed({k: f"__b{k}" for k in by}), [F.col(k) == F.col(f"__b{k}") for k in by], "left")
        lost = F.when(F.col("__n").isNull(), "unit_not_found").when(F.col("__n") > 1, "unit_not_unique")
        out = out.unionByName(located.select(
            *[F.when(F.col("__n") == 1, F.col(f"__place.{k}")).otherwise(F.col(k)).alias(k) for k in keys],
            *[c for c in rows.columns if c not in keys], lost.alias("__lost")))
    return out.drop("__named")


def _apply_final(base: DataFrame, keyed: DataFrame, final: DataFrame, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    updates = materialize(final.groupBy(*keys).agg(*[
        F.max(F.when(F.col("variable") == n, F.col("__f"))).alias(f"__u_{n}") for n in names
    ]))
    joined = keyed.join(updates, list(keys), "left")

    def merged(n: str) -> Column:
        if n not in names:
            return F.col(n)
        u = F.col(f"__u_{n}")
        value = u["v"].try_cast(base.schema[n].dataType)
        return F.when(u.isNull(), F.col(n)).otherwise(_carry(F.col(n), u["s"], value)).alias(n)

    return joined.select(*[merged(c) for c in base.columns])


def _problems(
    keyed: DataFrame, steps: DataFrame, folded: DataFrame, names: Sequence[str],
    keys: Sequence[str], cell: Sequence[str],
) -> DataFrame:
    def report(df: DataFrame, problem: Column, expected: str = "old_raw", found: str | None = None) -> DataFrame:
        return df.select(
            *cell, F.col("t").alias("change_datetime"), problem.alias("problem"),
            F.col(expected).cast("string").alias("expected"),
            (F.col(found) if found else F.lit(None)).cast("string").alias("found"),
        )

    unreadable = (
        (F.col("sets") & F.col("old").isNull()) | ((F.col("new_raw") != NONE) & F.col("new").isNull())
    )
    known = F.coalesce(F.col("variable").isin(*names), F.lit(False))
    kind = F.when(F.col("uneven"), "uneven_cells").when(~known, "unknown_variable").when(unreadable, "bad_value")
    badly_written = report(steps.where(kind.isNotNull()), kind)

    # Only base rows that some edit names are grouped.
    found = keyed.join(materialize(steps.select(*keys).distinct()), list(keys), "left_semi")
    cells = F.struct(*[F.col(n).cast("string").alias(n) for n in names])
    per_key = found.groupBy(*keys).agg(F.count("*").alias("__n"), F.first(cells).alias("__cells"))
    located = steps.join(per_key, list(keys), "left")
    where = F.when(F.col("__lost").isNotNull(), F.col("__lost")).when(F.col("__n").isNull(), "unit_not_found").when(F.col("__n") > 1, "unit_not_unique")
    unlocated = report(located.where(where.isNotNull()), where)

    base_value = F.lit(None).cast("string")
    for n in reversed(names):
        base_value = F.when(F.col("variable") == n, F.col("__cells")[n]).otherwise(base_value)
    entering = folded.select(*cell, "chunk", F.col("__before").alias("__enter"))
    state = null_safe_join(located.where("__n = 1"), entering, [*cell, "chunk"], "inner")
    before_chunk = _carry(base_value, F.col("__enter")["__seg"] > 0, F.col("__enter")["__after"])
    state = state.withColumn(
        "state", _carry(before_chunk, F.col("__before")["__seg"] > 0, F.col("__before")["__after"])
    )
    stale = state.where(F.col("sets") & ~F.col("old").eqNullSafe(F.col("state")) & F.col("old").isNotNull())
    return badly_written.unionByName(unlocated).unionByName(report(stale, F.lit("stale_old_value"), "old", "state"))


def apply_log(
    base: DataFrame, log: DataFrame, id_vars: Sequence[str] | None = None, allow_risky_names: bool = False
) -> DataFrame:
    """The edited table, or an error naming the first problems. Runs jobs for the checks."""
    cells = log_cells(log)
    if id_vars is None:
        id_vars = _few([r[0] for r in cells.select(F.explode(F.map_keys("ids"))).distinct().limit(MOST_SIGNATURES + 1).collect()], "id columns")
    used = cells.select(F.col("variable").alias("v")).where("v is not null").distinct()
    unknown = [r.v for r in used.where(~F.col("v").isin(*base.columns)).take(5)]
    if unknown:
        raise ValueError(f"The log changes columns the table does not have: {unknown}")
    require_unique(base, id_vars)  # edits never touch the keys
    # names that the table has: no more than its columns
    edited, problems = replay_log(base, cells, id_vars, sorted(r.v for r in used.collect()))
    examples = problems.orderBy("change_datetime").take(5)
    if examples:
        raise ValueError(f"The log cannot be applied, for example: {[r.asDict() for r in examples]}")
    return check_column_names(edited, allow=allow_risky_names)


def log_id_variables(log: DataFrame) -> list[str]:
    """Names of the unit id columns used in a log: a handful, whatever its length."""
    names = log.select(F.explode("change_details.unit_id").alias("u")).select("u.unit_id_variable").distinct()
    return _few([r[0] for r in names.limit(MOST_SIGNATURES + 1).collect()], "id columns")


def _few(names: list[str], what: str) -> list[str]:
    if len(names) > MOST_SIGNATURES:
        raise ValueError(f"The log names more than {MOST_SIGNATURES} {what}.")
    return sorted(n for n in names if n is not None)


def log_report(log: DataFrame) -> DataFrame:
    """One row per changed cell, for reading: when, who, which unit and what.

    ``unit`` lists the unit's ids as ``name=value``; a missing value reads ``None``.
    """
    details = F.col("change_details")
    unit = F.array_join(F.transform(
        details["unit_id"], lambda u: F.concat(u["unit_id_variable"], F.lit("="), u["unit_id_value"])
    ), ", ")
    rows = log.select(
        "change_datetime", F.col("data_source")[0].alias("data_source"), "data_target", "changed_by", unit.alias("unit"),
        "change_comment", details["old_value"].alias("olds"), details["new_value"].alias("news"),
    )
    cells = rows.select("*", F.posexplode_outer(F.arrays_zip("olds", "news")).alias("cell_no", "c")).drop("olds", "news")
    return cells.select(
        "change_datetime", "cell_no", F.coalesce("c.olds.variable_name", "c.news.variable_name").alias("variable"), "unit",
        F.coalesce("c.olds.value", F.lit(NONE)).alias("old_value"), F.coalesce("c.news.value", F.lit(NONE)).alias("new_value"),
        "changed_by", "change_comment", "data_source", "data_target",
    )


# --- batch edits of stored tables -----------------------------------------------------


def editable(edits: DataFrame, kind: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Flag the edits that a table of this kind allows.

    ``long``: only the value column. ``wide``: any column but the identifying ones.
    ``receipts``: the state of a response. ``schema``: the ``columns`` given.
    """
    target = F.col("column")
    rules = {
        "long": target == "value",
        "wide": ~target.isin("id", "unit", "ref", "form", "variable"),
        "receipts": target.isin("active", "edited", "status"),
        "schema": target.isin(*(columns or [])),
    }
    if kind not in rules:
        raise ValueError(f"'kind' must be one of {sorted(rules)}, not {kind!r}")
    return edits.withColumn("editable", rules[kind])


def edit_outcomes(
    table: DataFrame, edits: DataFrame, locate: Sequence[str], types: DataFrame | None = None,
    long: bool = True, check_old: bool = True, insert_missing: bool = False, table_name: str | None = None,
) -> DataFrame:
    """Judge a batch of edits ``(locate..., variable, old_value, value)``.

    Adds ``outcome`` (``updated``, ``inserted``, ``unchanged``, ``rejected``) and
    ``reason``. The batch is computed right away. It holds one edit per cell; several for one cell are rejected, as
    their order is not known (that is what a change log is for). Datatypes are those of the
    edit's period, or else of the period of the row it changes, and of ``table_name``.
    """
    key = [*locate, "variable"]
    edits = materialize(edits)
    by_period = types is not None and "period" in types.columns and "period" in table.columns
    period = F.col("period") if by_period else F.lit(None).cast("int")
    if long:
        current = table.select(*key, F.col("value").cast("string").alias("__now"), period.alias("__period"))
    else:
        columns = [c for c in table.columns if c not in locate]
        text = table.select(*locate, *[F.col(c).cast("string").alias(c) for c in columns], period.alias("__period"))
        current = text.join(edits.select(*locate).distinct(), list(locate), "left_semi").unpivot(
            [*locate, "__period"], columns, "variable", "__now")
    touched = current.join(edits.select(*key), key, "left_semi")
    found = touched.groupBy(*key).agg(F.count("*").alias("__n"), F.first("__now").alias("__now"), F.first("__period").alias("__period"))
    repeats = edits.groupBy(*key).agg(F.count("*").alias("__edits"))
    joined = edits.join(repeats, key).join(found, key, "left")
    if types is not None:
        one, on = types_per_variable(types, table, "datatype", table_name=table_name)
        if by_period:
            joined = joined.withColumn("__period", F.coalesce("period", "__period") if "period" in edits.columns else F.col("__period"))
            one, on = one.withColumnRenamed("period", "__period"), ["__period", "variable"]
        joined = joined.join(one, on, "left")
        status = datatype_status("value", "datatype")
    else:
        status = F.lit("ok")
    missing, same = F.col("__n").isNull(), F.col("old_value").eqNullSafe(F.col("value"))
    reason = (
        F.when(F.col("__edits") > 1, "several edits for one cell")
        .when(status != "ok", F.concat(F.lit("datatype "), status))
        .when(same, F.lit(None).cast("string"))
        .when(missing & F.lit(not insert_missing), "no such row")
        .when(F.col("__n") > 1, "row is not unique")
        .when(~missing & F.lit(check_old) & ~F.col("__now").eqNullSafe(F.col("old_value").cast("string")), "old value differs")
    )
    outcome = (
        F.when(F.col("reason").isNotNull(), "rejected").when(same, "unchanged")
        .when(missing, "inserted").otherwise("updated")
    )
    return joined.withColumn("reason", reason).withColumn("outcome", outcome).select(*edits.columns, "outcome", "reason")


def edit_values(
    table: DataFrame, edits: DataFrame, locate: Sequence[str], types: DataFrame | None = None,
    long: bool = True, check_old: bool = True, insert_missing: bool = False, table_name: str | None = None,
) -> DataFrame:
    """The table after the accepted edits of a batch; see ``edit_outcomes``. Runs a job."""
    key = [*locate, "variable"]
    judged = edit_outcomes(table, edits, locate, types, long, check_old, insert_missing, table_name)
    accepted = materialize(judged.where(F.col("outcome").isin("updated", "inserted")))
    if long:
        new = accepted.where(F.col("outcome") == "updated").select(
            *key, F.col("value").alias("__new"), F.lit(True).alias("__e")
        )
        changed = table.join(new, key, "left").withColumn(
            "value", F.when(F.col("__e"), F.col("__new").cast(table.schema["value"].dataType)).otherwise(F.col("value"))
        ).select(*table.columns)
        added = accepted.where(F.col("outcome") == "inserted").select(*[
            (F.col(c) if c in edits.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c)
            for c in table.columns
        ])
        return changed.unionByName(added) if insert_missing else changed
    names = [c for c in table.columns if c not in locate]
    wide = accepted.groupBy(*locate).agg(*[
        F.max(F.when(F.col("variable") == n, F.struct(F.col("value").cast("string").alias("v")))).alias(f"__u_{n}")
        for n in names
    ])
    return table.join(wide, list(locate), "left").select(*[
        F.col(c) if c in locate else
        F.when(F.col(f"__u_{c}").isNull(), F.col(c))
        .otherwise(F.col(f"__u_{c}")["v"].try_cast(table.schema[c].dataType)).alias(c)
        for c in table.columns
    ])


def advance_status(receipts: DataFrame, edited_refs: DataFrame) -> DataFrame:
    """Responses with edits go from untreated to in progress; other states stay."""
    marks = edited_refs.select("ref").distinct().withColumn("__m", F.lit(True))
    moved = F.when(F.col("__m") & (F.col("status") == UNTREATED), IN_PROGRESS).otherwise(F.col("status"))
    return receipts.join(marks, "ref", "left").withColumn("status", moved).select(*receipts.columns)


def set_receipt_fields(receipts: DataFrame, updates: DataFrame) -> DataFrame:
    """Set status, active, edited or comment by ``ref``; null in ``updates`` leaves a field alone."""
    fields = [c for c in updates.columns if c != "ref"]
    bad = [c for c in fields if c not in ("status", "active", "edited", "comment")]
    if bad:
        raise ValueError(f"These columns of a response cannot be set: {bad}")
    new = updates.select("ref", *[F.col(c).alias(f"__n_{c}") for c in fields])
    joined = receipts.join(new, "ref", "left")
    return joined.select(*[
        F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in receipts.columns
    ])


def history(changes: DataFrame, ref: str | None = None, hide_initial: bool = True, tz: str = "Europe/Oslo") -> DataFrame:
    """Changes newest first with local times, by default without the initial load."""
    rows = changes if ref is None else changes.where(F.col("ref") == ref)
    if hide_initial:
        rows = rows.where(F.col("process_type") != INITIAL_LOAD)
    return rows.orderBy(F.col("changed_at").desc()).withColumn("changed_at", local_seconds("changed_at", tz))

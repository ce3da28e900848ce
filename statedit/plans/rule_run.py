"""Running the sum rules: a whole period, one submission, or only what changed."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import YEARLY, Spine
from ..operators.joins import enrich_with_register
from ..operators.latest import active_version
from ..operators.rules import evaluate_changed, evaluate_sum_rules, rule_catalogue, touched_scope
from ..operators.upsert import replace_scope
from ..scratch import materialize


@dataclass
class RuleRun:
    """New state of the two tables after a run, as plans to be written by the caller."""

    hits: DataFrame
    catalogue: DataFrame | None = None


def period_hits(
    versions: DataFrame, update_counts: DataFrame, ledger: DataFrame, rules: DataFrame,
    period: Any, register: DataFrame | None = None, spine: Spine = YEARLY,
) -> DataFrame:
    """Hits of the active version of every unit in a period."""
    now = versions.where(spine.is_in([spine.period(period)]))
    scope = active_version(now, update_counts, ["unit", *spine.columns]).select("seq", "unit", *spine.columns)
    hits = evaluate_sum_rules(ledger, rules, scope).join(scope, "seq")
    return hits if register is None else enrich_with_register(hits, register)


def run_rules_for_period(
    existing_hits: DataFrame, existing_catalogue: DataFrame, versions: DataFrame,
    update_counts: DataFrame, ledger: DataFrame, rules: DataFrame, period: Any,
    last_run: Any, register: DataFrame | None = None, spine: Spine = YEARLY,
) -> RuleRun:
    """Replace a period's stored hits and catalogue rows of these rules."""
    hits = period_hits(versions, update_counts, ledger, rules, period, register, spine)
    fresh = rule_catalogue(rules, period, last_run, spine)
    scope = fresh.select(*spine.columns, "control_id")
    return RuleRun(
        hits=replace_scope(existing_hits, _shaped(hits, existing_hits), scope),
        catalogue=replace_scope(existing_catalogue, _shaped(fresh, existing_catalogue), scope),
    )


def run_rules_for_submission(
    existing_hits: DataFrame, versions: DataFrame, ledger: DataFrame, rules: DataFrame,
    seq: int, register: DataFrame | None = None,
) -> RuleRun:
    """Replace the stored hits of one submission."""
    scope = versions.where(F.col("seq") == seq).select("seq", "unit", "period")
    hits = evaluate_sum_rules(ledger.where(F.col("seq") == seq), rules).join(scope, "seq")
    hits = hits if register is None else enrich_with_register(hits, register)
    ids = rules.select("control_id").distinct().select(F.lit(seq).cast("bigint").alias("seq"), "control_id")
    return RuleRun(replace_scope(existing_hits, _shaped(hits, existing_hits), ids))


def run_rules_for_changes(
    existing_hits: DataFrame, versions: DataFrame, ledger: DataFrame, rules: DataFrame,
    changed: DataFrame, register: DataFrame | None = None,
) -> RuleRun:
    """Evaluate again only the rules that name a changed account, for many submissions at once."""
    scope = materialize(touched_scope(rules, changed))
    owners = versions.select("seq", "unit", "period")
    hits = evaluate_changed(ledger, rules, scope=scope).join(owners, "seq")
    hits = hits if register is None else enrich_with_register(hits, register)
    return RuleRun(replace_scope(existing_hits, _shaped(hits, existing_hits), scope))


def _shaped(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[
        (F.col(c) if c in df.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c)
        for c in like.columns
    ])

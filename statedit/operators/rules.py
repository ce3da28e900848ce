"""Account sum rules: ``lhs = sum(sign * account)`` within a threshold."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import exact_amount, matches
from ..functions.periods import YEARLY, Spine
from ..scratch import small_table

RULE_SCHEMA = (
    "control_id string, theme string, category string, description string, "
    "threshold double, account string, coef int"
)


@dataclass(frozen=True)
class SumRule:
    control_id: str
    theme: str
    lhs: str
    terms: tuple[tuple[str, int], ...]
    threshold: float = 1000
    category: str = "H"
    description: str = ""


def rule_terms(spark: SparkSession, rules: Sequence[SumRule]) -> DataFrame:
    """Rules in long form: one row per account, +1 for the left side, -sign for a term.

    An account named twice in a rule counts twice, so coefficients are added up.
    """
    rows = []
    for r in rules:
        if r.threshold < 0:
            raise ValueError(f"Rule {r.control_id!r}: the threshold must not be negative")
        coefs: dict[str, int] = {r.lhs: 1}
        for account, sign in r.terms:
            coefs[account] = coefs.get(account, 0) - sign
        rows += [
            (r.control_id, r.theme, r.category, r.description, float(r.threshold), a, c)
            for a, c in coefs.items()
        ]
    return small_table(spark, rows, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Long-form rules from JSON lines
    ``{control_id, theme, category, description, lhs, threshold, terms: [{account, sign}]}``.

    A line that cannot be read and a rule without a threshold fail the job.
    """
    raw = spark.read.schema(
        "control_id string, theme string, category string, description string, lhs string, "
        "threshold double, terms array<struct<account: string, sign: int>>"
    ).json(path, mode="FAILFAST")
    missing = F.raise_error(F.lit("A sum rule has no threshold.")).cast("double")
    raw = raw.withColumn("threshold", F.coalesce("threshold", missing))
    sides = F.concat(
        F.array(F.struct(F.col("lhs").alias("account"), F.lit(1).alias("coef"))),
        F.transform("terms", lambda t: F.struct(t["account"].alias("account"), (-t["sign"]).alias("coef"))),
    )
    return (
        raw.select("control_id", "theme", "category", "description", "threshold", F.inline(sides))
        .groupBy("control_id", "theme", "category", "description", "threshold", "account")
        .agg(F.sum("coef").cast("int").alias("coef"))
    )


def section_rule(
    control_id: str, theme: str, lhs: str, accounts: Sequence[str], start: int, end: int,
    contra: Sequence[str] = (), threshold: float = 1000, description: str = "",
) -> SumRule:
    """Rule for a section total: every account of a chart between two numbers, contra accounts negative."""
    inside = [a for a in accounts if a.isdigit() and start <= int(a) <= end]
    return SumRule(
        control_id, theme, lhs, tuple((a, -1 if a in contra else 1) for a in inside), threshold,
        description=description,
    )


def evaluate_sum_rules(ledger: DataFrame, rules: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Hits ``(control_id, seq, hit, value)`` where ``abs(lhs - sum) > threshold``.

    The ledger stays long: each amount meets the rules that name its account, and one
    aggregate per (submission, rule) adds the signed amounts. One shuffle for any number
    of rules, partial sums before it. ``scope`` restricts to submissions by ``seq``. The
    sums are exact decimals; a missing or unreadable amount counts as 0.
    """
    rows = ledger if scope is None else ledger.join(scope.select("seq"), "seq", "left_semi")
    # A theme on both sides keeps rules of one statement away from the other's ledger.
    on = ["account", "theme"] if "theme" in ledger.columns and "theme" in rules.columns else ["account"]
    signed = rows.select(*on, "seq", F.coalesce(exact_amount(rows), F.lit(0)).alias("__a")).join(
        rules.select(*on, "control_id", "threshold", "coef"), on
    )
    diff = signed.groupBy("seq", "control_id").agg(
        F.sum(F.col("__a") * F.col("coef")).alias("diff"),
        F.max("threshold").cast("decimal(28,6)").alias("limit"),
    )
    return diff.where(F.abs("diff") > F.col("limit")).select(
        "control_id", "seq", F.lit(True).alias("hit"), F.col("diff").cast("double").alias("value")
    )


def rules_touching(rules: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Ids of the rules that name any of the accounts; direct use only."""
    return rules.where(F.col("account").isin(list(fields))).select("control_id").distinct()


def touched_scope(rules: DataFrame, changed: DataFrame) -> DataFrame:
    """``(seq, control_id)`` pairs to evaluate again after changes to ``(seq, account)``."""
    return changed.select("seq", "account").distinct().join(
        rules.select("account", "control_id").distinct(), "account"
    ).select("seq", "control_id").distinct()


def evaluate_changed(
    ledger: DataFrame, rules: DataFrame, changed: DataFrame | None = None, scope: DataFrame | None = None
) -> DataFrame:
    """Hits of the touched rules of the touched submissions only; ``scope`` saves finding them."""
    scope = touched_scope(rules, changed) if scope is None else scope
    hits = evaluate_sum_rules(
        ledger, rules.join(scope.select("control_id").distinct(), "control_id", "left_semi"),
        scope.select("seq").distinct(),
    )
    return hits.join(scope, ["seq", "control_id"], "left_semi").select("control_id", "seq", "hit", "value")


def rule_catalogue(rules: DataFrame, period: Any, last_run: Any, spine: Spine = YEARLY) -> DataFrame:
    """One catalogue row per rule; the run time is given, never read from the clock."""
    return rules.select("control_id", "theme", "category", "description").distinct().select(
        *[F.lit(v).alias(c) for c, v in spine.filters(period).items()], "theme", "control_id", "category", "description",
        F.lit("value").alias("sort_by"), F.lit("DESC").alias("sort_order"),
        F.lit(last_run).cast("timestamp").alias("last_run"),
    )


def rule_hits(hits: DataFrame, period: int | None = None, seq: int | None = None, control_id: str | None = None) -> DataFrame:
    """Stored hits by any of the three filters, largest absolute value first."""
    wanted = {"period": period, "seq": seq, "control_id": control_id}
    return hits.where(matches({k: v for k, v in wanted.items() if v is not None})).orderBy(
        F.abs("value").desc_nulls_last(), "seq", "control_id"
    )

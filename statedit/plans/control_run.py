"""A control run from registration to the overview."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import matches
from ..operators.aggregates import control_overview
from ..operators.controls import ControlContext, ControlFunction, register_controls, run_controls, sync_hits


@dataclass
class ControlRun:
    catalogue: DataFrame
    hits: DataFrame

    def overview(self, receipts: DataFrame) -> DataFrame:
        fired = self.hits.drop("outcome")
        return control_overview(self.catalogue, fired, receipts)


def run_control_suite(
    controls: Iterable[ControlFunction], context: ControlContext,
    existing_catalogue: DataFrame, existing_hits: DataFrame,
) -> ControlRun:
    """Register, run, check, and bring the stored hits in step with the results."""
    controls = list(controls)
    catalogue = register_controls(existing_catalogue, controls, context.scope)
    results = run_controls(controls, context)
    scope_cols = [c for c in context.scope if c in existing_hits.columns]
    if "form" in existing_hits.columns and "form" not in results.columns:
        results = results.withColumn("form", F.lit(None).cast("string"))
    # Rows of other periods and forms cannot change: only the scope's own rows are joined.
    mine = F.coalesce(matches({c: context.scope[c] for c in scope_cols}), F.lit(False))
    synced = sync_hits(existing_hits.where(mine), results, scope_cols)
    others = existing_hits.where(~mine).withColumn("outcome", F.lit("untouched"))
    return ControlRun(catalogue, synced.unionByName(others))

"""Totals this period against the one before, straight from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import period_totals
from ..sources.tables import extend_previous_period, partition_filter, scan_table


def period_report(
    spark: SparkSession, root: str, period: int, form: str | None = None, table: str = "observations"
) -> DataFrame:
    """``period_totals`` over the tables below ``root``, reading two periods' folders only."""
    form = None if form == "all" else form
    chosen = extend_previous_period(partition_filter(["period"], form, period=period), "period")
    types = scan_table(spark, f"{root}/types", {"period": period}).select("variable", "datatype").distinct()
    return period_totals(
        scan_table(spark, f"{root}/{table}", chosen), scan_table(spark, f"{root}/receipts", chosen), types, period, form
    )

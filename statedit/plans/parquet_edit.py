"""A table with its pending edits, as the editor sees it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.editlog import apply_log
from ..operators.quality import check_column_names, require_unique
from ..sources.logs import log_path, read_change_log
from ..sources.tables import path_exists


def open_for_editing(spark: SparkSession, path: str, id_vars: list[str], allow_risky_names: bool = False) -> DataFrame:
    """The stored table, with its work log replayed when there is one."""
    df = spark.read.parquet(path)
    work_log = log_path(path)
    if path_exists(spark, work_log):
        df = apply_log(df, read_change_log(spark, work_log), allow_risky_names=allow_risky_names)
    check_column_names(df, allow_risky_names)
    return require_unique(df, id_vars)

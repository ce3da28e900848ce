"""Change-log files: their paths, reading, writing, and the export of an edited table.

Where a log lies is a fixed contract with the tools that write and archive logs.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.editlog import LOG_SCHEMA, TARGET_PLACEHOLDER, apply_log
from .ordered import numbered, read_json_arrays, read_pieces, running
from .tables import path_exists

# Folder names of the data states.
DATA_STATES = ("inndata", "klargjorte-data", "statistikk", "utdata")

# Fixed value: ending of a log file's name.
LOG_SUFFIX = "-change-data-log.jsonl"


def _state_index(parts: Sequence[str]) -> int | None:
    return next((i for i, p in enumerate(parts) if p in DATA_STATES), None)


def log_path(data_path: str) -> str:
    """Work log of a table: below the data state's ``temp/parqueteditor``, or next to the table."""
    p = PurePosixPath(data_path)
    i = _state_index(p.parts)
    if i is None:
        return str(p.with_suffix(".jsonl"))
    root, rest = PurePosixPath(*p.parts[: i + 1]), PurePosixPath(*p.parts[i + 1:])
    return str(root / "temp" / "parqueteditor" / rest.with_name(rest.stem + LOG_SUFFIX))


def export_log_path(target: str) -> str:
    """Log of an exported table: below ``logg/prosessdata``, keeping the path from the data state on."""
    p = PurePosixPath(target)
    i = _state_index(p.parts)
    if i is None:
        raise ValueError(f"No data state {DATA_STATES} in the path {target!r}")
    root, rest = PurePosixPath(*p.parts[:i]), PurePosixPath(*p.parts[i:])
    return str(root / "logg" / "prosessdata" / rest.with_name(rest.stem + LOG_SUFFIX))


def read_change_log(spark: SparkSession, path: str) -> DataFrame:
    """A log as JSON lines, or as JSON arrays or a single object; a file or a folder of such files.

    ``seq`` breaks ties between equal times: as written, else the place among all rows, by
    file name, then by the order in the file. All files of a folder are of one kind, told by the
    first line. Lines and arrays are read by many tasks. What is no log row fails the job.
    """
    head = spark.read.text(path).where(F.trim("value") != "").head()
    first = head[0].strip() if head else ""
    schema = f"{LOG_SCHEMA}, seq long"
    if first == "{":  # one object over several lines
        rows = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")
        return rows.withColumn("seq", F.coalesce("seq", F.lit(0)))
    if first.startswith("["):
        elements = read_json_arrays(spark, path).select("file", F.lit(0).alias("block"), F.col("no").alias("pos"), "value")
        texts = running(elements, F.lit(1), "__no", per_file=False)
    else:
        texts = numbered(read_pieces(spark, path, blank=False), "__no")
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    return texts.select("__no", row.alias("r")).select("r.*", "__no").withColumn("seq", F.coalesce("seq", "__no")).drop("__no")


def write_change_log(log: DataFrame, path: str, mode: str = "append") -> None:
    log.write.mode(mode).json(path)


def export_edited(
    spark: SparkSession, source: str, target: str, overwrite: bool = False,
    id_vars: Sequence[str] | None = None, allow_risky_names: bool = False,
) -> str:
    """Write the edited table to ``target`` and its log beside it; returns the log's path.

    Refuses when the log is missing, or when target or exported log exist and
    ``overwrite`` is not set. Log rows that still name the placeholder get the target.
    """
    work_log = log_path(source)
    if not path_exists(spark, work_log):
        raise FileNotFoundError(f"No change log at {work_log!r}: nothing was edited in {source!r}")
    exported = export_log_path(target)
    for path in (exported, target):
        if path_exists(spark, path) and not overwrite:
            raise FileExistsError(f"{path!r} exists; pass overwrite=True to replace it")
    log = read_change_log(spark, work_log)
    # All checks of the replay run before anything is written.
    edited = apply_log(spark.read.parquet(source), log, id_vars, allow_risky_names)
    mode = "overwrite" if overwrite else "errorifexists"
    done = log.withColumn(
        "data_target",
        F.when(F.col("data_target") == TARGET_PLACEHOLDER, F.lit(target)).otherwise(F.col("data_target")),
    )
    edited.write.mode(mode).parquet(target)
    write_change_log(done.orderBy("change_datetime", "seq"), exported, mode)
    return exported

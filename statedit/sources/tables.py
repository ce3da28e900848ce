"""Reading and writing the survey tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import matches
from ..functions.frames import null_safe_join, one_per_key
from ..operators.filters import align_columns
from ..operators.quality import check_column_names, require_unique
from ..schema import core_schemas, partition_columns
from ..scratch import materialize


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system of the path, so object stores work like local folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def partition_filter(
    units: Sequence[str], form: str | None = None, **values: Any
) -> dict[str, list[Any]]:
    """Partition selection from the period columns wanted and their chosen values."""
    chosen = {u: [values[u]] for u in units if u in values}
    if form is not None:
        chosen["form"] = [form]
    return chosen


def extend_previous_period(partitions: Mapping[str, list[Any]], key: str, n: int = 1) -> dict[str, list[Any]]:
    """Add the ``n`` periods before the earliest selected one."""
    out = {k: list(v) for k, v in partitions.items()}
    if out.get(key):
        first = int(min(out[key]))
        out[key] += [first - i for i in range(1, n + 1)]
    return out


def scan_table(
    spark: SparkSession, path: str, partitions: Mapping[str, Any] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Read a partitioned table; the selection prunes its folders before any file is opened."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path).where(matches(partitions))


#: Partitions that are named in a predicate; beyond, the choice is joined.
MOST_NAMED = 1000


def scan_chosen(spark: SparkSession, path: str, wanted: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a partitioned table whose partition columns occur in ``wanted``, a computed choice.

    The distinct choice is computed right away. Up to ``MOST_NAMED`` partitions become a
    predicate, so that no file of another folder is opened; a larger choice is joined, where
    Spark prunes at run time. Null in ``wanted`` means the folder of nulls. The columns of
    ``wanted`` must be partition columns.
    """
    columns = wanted.columns
    chosen = materialize(wanted.distinct())
    rows = chosen.limit(MOST_NAMED + 1).collect()
    table = scan_table(spark, path, schema=schema)
    if len(rows) > MOST_NAMED:
        return null_safe_join(table, chosen, columns, "left_semi")
    tests = [reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == v for c, v in zip(columns, r)]) for r in rows]
    return table.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def read_parquet_checked(spark: SparkSession, path: str, id_vars: Sequence[str], allow_risky_names: bool = False) -> DataFrame:
    """Parquet whose key must be unique and whose column names must be safe."""
    if not isinstance(id_vars, list) or not all(isinstance(v, str) for v in id_vars):
        raise TypeError("'id_vars' must be a list of strings")
    df = spark.read.parquet(path)
    check_column_names(df, allow_risky_names)
    return require_unique(df, id_vars)


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], schema: str, sep: str = ";", header: bool = True
) -> DataFrame:
    """One or more delimited files with one schema; empty text stays empty and is never null.

    A cell that does not fit its type fails the job.
    """
    raw = spark.read.schema(schema).options(sep=sep, header=header, enforceSchema=False, mode="FAILFAST").csv(
        [paths] if isinstance(paths, str) else list(paths)
    )
    return raw.fillna("")


@dataclass(frozen=True)
class Source:
    """One candidate of a register: where it lies and how its columns map to ours."""

    path: str
    rename: Mapping[str, str] = field(default_factory=dict)
    format: str = "parquet"


def read_first_available(
    spark: SparkSession, sources: Sequence[Source], expected: Sequence[str], key: str,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Rows of the first source that exists and has any of the wanted keys.

    Columns are renamed, absent ones are filled with ``""``, and one row per key is
    kept. Only existence is tested ahead; sources further down are not read.
    """
    for source in sources:
        if not path_exists(spark, source.path):
            continue
        try:
            raw = spark.read.format(source.format).load(source.path)
        except AnalysisException:
            # An unreadable candidate is passed over like a missing one.
            continue
        df = align_columns(raw, source.rename, expected)
        df = df.withColumn(key, F.col(key).cast("string"))
        if wanted is not None:
            df = df.join(wanted.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")
        if not df.isEmpty():
            return one_per_key(df, [key], [F.col(c).asc_nulls_last() for c in expected if c != key] or [F.col(key)])
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in expected]))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in schema order and type; absent ones are null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def write_partitioned(
    df: DataFrame, path: str, table: str, periods: Sequence[str] = ("period",), mode: str = "errorifexists",
    schema: T.StructType | None = None,
) -> None:
    """Write a core table in its storage layout.

    The rebalance hint lets AQE gather small folders into few files and split a folder
    that holds most rows over many tasks.
    """
    folders = partition_columns(table, periods)
    rows = conform(df, schema or core_schemas(periods)[table])
    rows.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).parquet(path)


def save_bucketed(
    df: DataFrame, name: str, table: str, buckets: int, key: str = "ref",
    periods: Sequence[str] = ("period",), mode: str = "errorifexists",
) -> None:
    """Save a core table in the catalog, bucketed and sorted by ``key`` inside its folders.

    Semi joins and joins on ``key`` (such as ``responses_in``) then read the large table
    without a shuffle; only the small side is exchanged. Choose ``buckets`` so that one
    bucket of one folder fits a task.
    """
    rows = conform(df, core_schemas(periods)[table])
    (
        rows.repartition(buckets, key).write.mode(mode).partitionBy(*partition_columns(table, periods))
        .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    )


def overwrite_partitions(df: DataFrame, path: str, folders: Sequence[str]) -> None:
    """Replace only the folders that occur in ``df``.

    ``df`` must not read ``path`` itself; materialize it first if it does.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)

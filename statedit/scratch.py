"""Intermediate results in the shared folder, and small tables of literals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster must name
    one, because a folder of a single machine is lost with that machine.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="statedit-"))
        path = context.getCheckpointDir()
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table; all of one application lie together and may go with it."""
    return f"{shared_dir(spark)}/statedit-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder, and read back: the lineage ends there.

    A lost executor then costs a read and not the computation, and Catalyst knows the
    size of what it joins.
    """
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame) -> DataFrame:
    """A small table of statistics, computed once and stored.

    There is no hint: Catalyst broadcasts it below its threshold, by the size of the files,
    and joins by a shuffle beyond.
    """
    return materialize(df)


def measured(df: DataFrame) -> tuple[DataFrame, bool]:
    """The table computed once, and whether its files are below the threshold of broadcasts."""
    spark = df.sparkSession
    stored, path = _stored(df)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return stored, size <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over the session's shuffle partitions, none of them merged.

    For groups of few rows: a count before the shuffle would hold nearly every row of a
    task, and merged partitions hold the more the larger the table is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once no DataFrame needs them."""
    path = f"{shared_dir(spark)}/statedit-{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small_table(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
    """Literal rows as a local relation, whose size Catalyst knows when it picks a join."""
    parsed = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [()] * len(parsed.fields)
    table = pa.table(
        [pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, parsed.fields)],
        names=parsed.fieldNames(),
    )
    return spark.createDataFrame(table)

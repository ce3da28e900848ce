"""Outliers between two periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import attach
from ..functions.ordered import exact_quantiles
from ..scratch import materialize, settle


def hb_outliers(
    df: DataFrame, id: str, x1: str, x2: str, p_c: float = 20, p_u: float = 0.5, p_a: float = 0.05,
    strata: Sequence[str] = (), accuracy: int = 100_000, stored: bool = False,
) -> DataFrame:
    """Hidiroglou-Berthelot test of the ratio ``x1/x2`` (Survey Methodology 12, 1986).

    Only units with both values above zero are tested; units with equal values take part
    only while they are under half of their stratum. Every unit is returned, untested
    ones with null limits and ``outlier = 0``.

    The statistics per stratum are computed right away. Their steps read the values
    several times, so these are materialized first; ``stored`` says that ``df`` is a
    plain stored table and can be read again as it is.
    """
    strata = list(strata)
    a, b = F.col(x1).cast("double"), F.col(x2).cast("double")
    base = df.select(F.col(id).alias("id"), *strata, a.alias("x1"), b.alias("x2"))
    base = base if stored else materialize(base)
    positive = (F.col("x1") > 0) & (F.col("x2") > 0)
    share = settle(base.groupBy(*strata).agg(
        F.count_if(positive).alias("__n"), F.count_if(positive & (F.col("x1") == F.col("x2"))).alias("__eq")
    ))
    keep_equal = F.col("__eq") * 2 < F.col("__n")
    flagged = attach(base, share, strata).withColumn(
        "__in", F.coalesce(positive & ((F.col("x1") != F.col("x2")) | keep_equal), F.lit(False))
    ).drop("__n", "__eq")
    # Filters may be reordered, so no division here may raise on an untested unit.
    ratio = F.try_divide("x1", "x2")
    tested = flagged.where("__in").withColumn("ratio", ratio)
    medians = settle(exact_quantiles(tested, strata, "ratio", {"__rm": 0.5}, accuracy, stored=True).drop("n"))

    def scored(rows: DataFrame) -> DataFrame:
        s = F.when(F.col("ratio") < F.col("__rm"), 1 - F.try_divide("__rm", "ratio")).otherwise(
            F.try_divide("ratio", "__rm") - 1
        )
        max_x = F.greatest("x1", "x2")
        return (
            attach(rows, medians, strata).withColumn("max_x", max_x)
            .withColumn("__w", F.pow(max_x, F.lit(float(p_u)))).withColumn("__E", s * F.col("__w"))
        )

    quartiles = settle(exact_quantiles(
        scored(tested), strata, "__E", {"__q1": 0.25, "__q2": 0.5, "__q3": 0.75}, accuracy, stored=True
    ).drop("n"))
    floor_d = F.abs(F.lit(float(p_a)) * F.col("__q2"))
    low = F.col("__q2") - p_c * F.greatest(F.col("__q2") - F.col("__q1"), floor_d)
    high = F.col("__q2") + p_c * F.greatest(F.col("__q3") - F.col("__q2"), floor_d)

    def as_ratio(limit):
        u = F.try_divide(limit, F.col("__w"))
        return F.when(u >= 0, F.col("__rm") * (1 + u)).otherwise(F.try_divide(F.col("__rm"), 1 - u))

    judged = attach(scored(tested), quartiles, strata).select(
        "id", *strata, "x1", "x2", "ratio", "max_x", as_ratio(low).alias("lower_limit"),
        as_ratio(high).alias("upper_limit"),
        ((F.col("__E") < low) | (F.col("__E") > high)).cast("int").alias("outlier"),
    )
    none = F.lit(None).cast("double")
    untested = flagged.where(~F.col("__in")).select(
        "id", *strata, "x1", "x2",
        F.when(positive, ratio).alias("ratio"), F.greatest("x1", "x2").alias("max_x"),
        none.alias("lower_limit"), none.alias("upper_limit"), F.lit(0).alias("outlier"),
    )
    return judged.unionByName(untested)


def thousand_errors(df: DataFrame, id: str, x1: str, x2: str, threshold: float = 2.5) -> DataFrame:
    """Unit-of-measure errors: values apart by about a factor of 1000.

    All rows are returned with a flag. The default threshold, on the log10 of the
    ratio, is our choice.
    """
    a, b = F.col(x1).cast("double"), F.col(x2).cast("double")
    positive = (a > 0) & (b > 0)
    diff = F.when(positive, F.log10(F.try_divide(a, b)))
    return df.select(
        F.col(id).alias("id"), a.alias("x1"), b.alias("x2"), diff.alias("log_ratio"),
        F.coalesce((F.abs(diff) > threshold).cast("int"), F.lit(0)).alias("outlier"),
    )

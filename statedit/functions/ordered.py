"""Exact order statistics and running totals that no single task has to see whole.

``percentile`` keeps every value of a group in one buffer, and a window ordered over a
group sorts the group in one task. Neither survives a group with a third of all rows,
so both are done in two levels here: a sketch or ranges split the group, and only counts
travel between the levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import materialize, settle
from .frames import attach, null_safe_join

BEFORE = (Window.unboundedPreceding, -1)
UPTO = (Window.unboundedPreceding, Window.currentRow)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column | str,
    probs: dict[str, float],
    accuracy: int = 100_000,
    stored: bool = False,
) -> DataFrame:
    """One row per group: ``by``, ``n`` and one linearly interpolated quantile per name.

    A first aggregate takes counts, extremes and a mergeable sketch, which brackets each
    inner quantile between two values whose ranks are at most ``10/accuracy`` of the group
    apart. A second pass counts what lies below the bracket and keeps the distinct values
    inside it, from which the exact order statistics of all quantiles are read together.
    Only that sliver of a group is ever sorted; a group of fewer than ``accuracy`` rows is
    one bracket for all its quantiles.

    The first aggregate runs right away (one row per group); the rest is lazy. The input is
    read once and its narrow columns are stored, unless it is ``stored`` already. It is
    shuffled by group only if the sketches are too many to broadcast.
    """
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, x.cast("double").alias("__x")).where("__x is not null")
    if not stored:
        rows = materialize(rows)
    inner = {name: p for name, p in probs.items() if 0 < p < 1}
    # The sketch errs by 1/accuracy, and interpolation needs the neighbours of a rank.
    margin = 4.0 / accuracy
    edges = [e for p in inner.values() for e in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = settle(rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("__x").alias("__min"), F.max("__x").alias("__max"),
        *([F.percentile_approx("__x", [float(e) for e in edges], accuracy).alias("__e")] if inner else []),
    ))
    extremes = [F.col("__min" if p <= 0 else "__max").alias(n) for n, p in probs.items() if n not in inner]
    if not inner:
        return sketch.select(*by, "n", *extremes)
    small = F.col("n") < accuracy
    whole = F.array(F.struct(F.lit(-1).alias("i"), F.col("__x").alias("v"), F.lit(True).alias("keep")))
    brackets = F.array(*[
        F.struct(
            F.lit(i).alias("i"),
            # Null stands for "below the bracket": only its count matters.
            F.when(F.col("__x") >= F.col("__e")[2 * i], F.col("__x")).alias("v"),
            (F.col("__x") <= F.col("__e")[2 * i + 1]).alias("keep"),
        )
        for i in range(len(inner))
    ])
    hist = (
        attach(rows, sketch, by)
        .select(*by, "n", "__min", "__max", F.inline(F.when(small, whole).otherwise(F.filter(brackets, lambda b: b["keep"]))))
        .groupBy(*by, "n", "__min", "__max", "i", "v")
        .agg(F.count("*").alias("c"))
    )
    w = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(*UPTO)
    ranked = hist.withColumn("end", F.sum("c").over(w))

    def at(i: int, rank: Column) -> Column:
        inside = F.col("i").isin(-1, i) & (F.col("end") - F.col("c") <= rank) & (rank < F.col("end"))
        return F.max(F.when(inside, F.col("v")))

    places = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in inner.items()}
    picked = ranked.groupBy(*by, "n", "__min", "__max").agg(*[
        at(i, side(pos)).alias(f"__{tag}{i}")
        for i, pos in enumerate(places.values()) for tag, side in (("a", F.floor), ("b", F.ceil))
    ])

    def between(i: int, pos: Column) -> Column:
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        gone = F.raise_error(F.lit("Quantile left its bracket; raise the accuracy.")).cast("double")
        return F.when(a.isNull() | b.isNull(), gone).otherwise(a + (b - a) * (pos - F.floor(pos)))

    found = {name: between(i, pos).alias(name) for i, (name, pos) in enumerate(places.items())}
    found |= {n: F.col("__min" if p <= 0 else "__max").alias(n) for n, p in probs.items() if n not in inner}
    return picked.select(*by, "n", *[found[n] for n in probs])


#: Rows of one range of a running total.
RANGE_ROWS = 1 << 18


def running_total(
    df: DataFrame, by: Sequence[str], key: Column, amount: str, out: str = "running", range_rows: int | None = None
) -> DataFrame:
    """Running sum of ``amount`` along the numeric ``key`` within ``by``; null keys come last.

    ``df`` must be unique on (``by``, ``key``). The rows are stored, and dealt by ranges of
    (``by``, ``key``) so that none has much more than ``range_rows``; every range is summed
    on its own, and what lies in front of it comes from a table with one row per group and range.
    """
    rows = materialize(df.withColumn("__k", key))
    ranges = max(1, -(-rows.count() // (range_rows or RANGE_ROWS)))
    order = F.col("__k").asc_nulls_last()
    if ranges == 1:
        along = Window.partitionBy(*by).orderBy(order).rowsBetween(*UPTO)
        return rows.withColumn(out, F.sum(amount).over(along)).drop("__k")
    dealt = materialize(rows.repartitionByRange(ranges, *by, order).withColumn("__p", F.spark_partition_id()))
    front = Window.partitionBy(*by).orderBy("__p").rowsBetween(*BEFORE)
    offsets = dealt.groupBy(*by, "__p").agg(F.sum(amount).alias("__t")).select(
        *by, "__p", F.coalesce(F.sum("__t").over(front), F.lit(0)).alias("__o"))
    along = Window.partitionBy(*by, "__p").orderBy(order).rowsBetween(*UPTO)
    local = dealt.withColumn("__l", F.sum(amount).over(along))
    return (
        null_safe_join(local, offsets, [*by, "__p"], "inner")
        .withColumn(out, F.col("__o") + F.col("__l"))
        .drop("__k", "__p", "__o", "__l")
    )


def rank_within(df: DataFrame, by: Sequence[str], order: Column, out: str = "rank") -> DataFrame:
    """``rank() over (partition by by order by order)`` without one task per group.

    Rows are first reduced to counts per distinct value, the counts are summed with
    ``running_total``, and the ranks are joined back. Nulls rank last.
    """
    rows = materialize(df.withColumn("__v", order.cast("double")))
    counts = rows.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    total = running_total(counts, by, F.col("__v"), "__c", "__run")
    ranks = total.select(*by, "__v", (F.col("__run") - F.col("__c") + 1).alias(out))
    return null_safe_join(rows, ranks, [*by, "__v"], "inner").drop("__v")

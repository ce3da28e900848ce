import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statedit.functions import ordered
from statedit.functions.ordered import exact_quantiles, rank_within, running_total

PROBS = {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9, "hi": 1.0}


def expected(values):
    return [float(np.quantile(values, p)) for p in PROBS.values()]


def got(df, by):
    return {tuple(r[b] for b in by): (r["n"], [r[p] for p in PROBS]) for r in df.collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, q = got(exact_quantiles(df, [], "v", PROBS), [])[()]
    assert n == len(values)
    assert q == pytest.approx(expected(values))


@pytest.mark.parametrize("accuracy", [100, 1000, 100_000])
def test_quantiles_of_a_hot_group(spark, accuracy):
    """One group holds most rows, and one value a third of them; brackets are narrow and wide."""
    rng = random.Random(1)
    rows = [("hot", 7.0 if i % 3 == 0 else rng.gauss(0, 100)) for i in range(6000)]
    rows += [(f"g{i % 50}", rng.random()) for i in range(500)] + [("nulls", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = got(exact_quantiles(df, ["g"], "v", PROBS, accuracy), ["g"])
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault((g,), []).append(v)
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g][0] == len(values)
        assert found[g][1] == pytest.approx(expected(values))


def test_running_total(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.randint(1, 9)) for i in range(700)] + [("b", 5, 2), ("b", 1, 1), ("b", None, 4)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, n int")
    total = {(r.g, r.k): r.running for r in running_total(df, ["g"], F.col("k"), "n", range_rows=40).collect()}
    for group in ("a", "b"):
        run = 0
        for _, k, n in sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is None, r[1])):
            run += n
            assert total[group, k] == run


def test_running_total_of_one_range(spark, rows):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), ("b", None, 7), ("a", None, 2)], "g string, k int, n int")
    assert rows(running_total(df, ["g"], F.col("k"), "n"), "g", "k", "running") == [("a", None, 8), ("a", 1, 5), ("a", 2, 6), ("b", None, 7)]
    assert running_total(df.limit(0), ["g"], F.col("k"), "n").count() == 0


def test_rank_within_equals_the_window_rank(spark, rows, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 60)
    rng = random.Random(3)
    data = [("hot", rng.choice([1.0, 1.0, 1.0, rng.random() * 50])) for _ in range(800)]
    data += [("cold", float(i % 4)) for i in range(20)] + [("cold", None)]
    df = spark.createDataFrame(data, "g string, v double").withColumn("id", F.monotonically_increasing_id())
    mine = rank_within(df, ["g"], -F.col("v"))
    df.createOrReplaceTempView("to_rank")
    window = spark.sql("SELECT g, v, id, rank() OVER (PARTITION BY g ORDER BY -v NULLS LAST) AS rank FROM to_rank")
    assert rows(mine, "id", "rank") == rows(window.select("id", F.col("rank").cast("long").alias("rank")))

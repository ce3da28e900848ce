import random

import numpy as np
import pytest

from statedit.operators import outliers as O


def hb(pairs, p_c, p_u=0.5, p_a=0.05):
    """The method with numpy, one stratum."""
    ok = {k: (a, b) for k, (a, b) in pairs.items() if a is not None and b is not None and a > 0 and b > 0}
    equal = [k for k, (a, b) in ok.items() if a == b]
    if len(equal) * 2 >= len(ok):
        ok = {k: v for k, v in ok.items() if k not in equal}
    if not ok:
        return {k: 0 for k in pairs}
    r = {k: a / b for k, (a, b) in ok.items()}
    m = np.quantile(list(r.values()), 0.5)
    e = {k: (1 - m / x if x < m else x / m - 1) * max(ok[k]) ** p_u for k, x in r.items()}
    q1, q2, q3 = np.quantile(list(e.values()), [0.25, 0.5, 0.75])
    lo, hi = q2 - p_c * max(q2 - q1, abs(p_a * q2)), q2 + p_c * max(q3 - q2, abs(p_a * q2))
    return {k: int(k in e and (e[k] < lo or e[k] > hi)) for k in pairs}


@pytest.mark.parametrize("equal", [0.2, 0.7])
def test_hb_matches_the_definition(spark, equal):
    rng = random.Random(7)
    data = {}
    for i in range(600):
        x = rng.choice([None, 0.0, -1.0]) if rng.random() < 0.05 else rng.lognormvariate(5, 1)
        y = x if rng.random() < equal else (None if x is None else x * rng.lognormvariate(0, 0.3 if rng.random() < 0.95 else 3))
        # One stratum holds most units.
        data[i] = ("big" if i % 6 else f"s{i % 4}", x, y)
    df = spark.createDataFrame([(k, *v) for k, v in data.items()], "id long, s string, x1 double, x2 double")
    for accuracy in (50, 100_000):
        out = {r.id: r for r in O.hb_outliers(df, "id", "x1", "x2", p_c=3, strata=["s"], accuracy=accuracy).collect()}
        assert set(out) == set(data)
        for stratum in {v[0] for v in data.values()}:
            expected = hb({k: v[1:] for k, v in data.items() if v[0] == stratum}, 3)
            assert {k: out[k].outlier for k in expected} == expected
        for r in out.values():
            if r.lower_limit is not None:
                assert r.outlier == int(not r.lower_limit <= r.ratio <= r.upper_limit)
    whole = O.hb_outliers(df, "id", "x1", "x2", p_c=3, stored=True)
    expected = hb({k: v[1:] for k, v in data.items()}, 3)
    assert {r.id: r.outlier for r in whole.collect()} == expected


def test_hb_of_one_unit_and_of_none(spark):
    one = spark.createDataFrame([(1, 2.0, 1.0)], "id long, x1 double, x2 double")
    assert O.hb_outliers(one, "id", "x1", "x2").first().outlier == 0


def test_thousand_errors(spark, rows):
    df = spark.createDataFrame([(1, 5000.0, 5.0), (2, 5.0, 4.0), (3, 0.0, 5.0), (4, None, 1.0), (5, 1.0, 900.0)], "id long, x1 double, x2 double")
    assert rows(O.thousand_errors(df, "id", "x1", "x2"), "id", "outlier") == [(1, 1), (2, 0), (3, 0), (4, 0), (5, 1)]

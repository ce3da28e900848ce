import math
import random

import numpy as np
from pyspark.sql import functions as F

from statedit.llm import negatives as N

ROWS = "id long, vector array<float>, label int, rank string, v string"


def brute(rows, every, positives=5, negatives=10):
    part = [(k, [math.floor(256 * float(np.float32(x))) for x in v], lab) for k, v, lab in rows
            if k is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for k, v, lab in sorted(part, key=lambda r: (r[0], r[2], r[1])):
        if k % every == 0:
            anchors.setdefault(k, (v, lab))
    out = []
    for a, (av, alab) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(av, v)), k, lab) for k, v, lab in part if k != a]
        scored.sort()
        for p, pk, _ in [r for r in scored if r[2] == alab][:positives]:
            window = [(n, k) for n, k, lab in scored if lab != alab and 30 * -p <= 100 * -n <= 90 * -p]
            out += [(a, pk, r + 1, k, -p, -n) for r, (n, k) in enumerate(window[:negatives])]
    return sorted(out)


def run(spark, rows, every, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], ROWS).repartition(3)
    return sorted(tuple(r) for r in N.mine(df, F.col("id") % every == 0, **options).collect())


def clustered(seed, n, dims):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    out = []
    for k in range(n):
        v = centres[k % 6] * rng.choice([0, 0.5, 1.0]) + rng.normal(size=dims) * rng.choice([0.2, 1.0])
        v[rng.random(dims) < 0.3] = 0
        out.append((k, (v / max(1e-9, np.linalg.norm(v))).astype(np.float32).tolist(), int(rng.integers(0, 4))))
    return out


def test_against_brute_force(spark):
    for seed, n, dims in ((1, 300, 40), (2, 200, 7)):
        rows = clustered(seed, n, dims)
        assert run(spark, rows, 25) == brute(rows, 25)


def test_small_batches_blocks_and_copies(spark, monkeypatch):
    for name, value in (("BATCH_ROWS", 16), ("ANCHORS_AT_ONCE", 3), ("SEGMENT", 4)):
        monkeypatch.setattr(N, name, value)
    rows = clustered(3, 150, 18)
    rows += [(1000 + k, rows[4][1], 2) for k in range(40)] + [(2000 + k, rows[5][1], k % 2) for k in range(30)]
    assert run(spark, rows, 20, block_bytes=300) == brute(rows, 20)


def test_large_values_stay_exact(spark):
    rng = random.Random(5)
    for size in (30.0, 1e5, 5e5):  # scores in 32-bit, 64-bit floats and in integers
        rows = [(k, [rng.uniform(-size, size) for _ in range(5)], k % 2) for k in range(60)]
        assert run(spark, rows, 10) == brute(rows, 10)


def test_what_takes_no_part(spark):
    good = [(k, [1.0, 0.1 * (k % 9)], k % 2) for k in range(40)]
    bad = [(None, [1.0, 1.0], 1), (50, None, 1), (60, [1.0, None], 1), (70, [float("nan"), 1.0], 0), (80, [float("inf"), 1.0], 0),
           (90, [1.0, 1.0], None), (100, [], 1), (110, [3e38, 3e38], 1)]
    assert run(spark, good + bad, 10) == brute(good, 10)
    twice = good + good[:15] + [(20, [0.2, 0.9], 1), (3, [0.5], 1)]
    assert run(spark, twice, 10) == brute(twice, 10)
    assert run(spark, [], 10) == [] and run(spark, bad, 10) == [] and run(spark, [(10, [1.0], 0)], 10) == []


def test_opposite_and_zero_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [0.0, 0.5], 1), (4, [-0.5, 0.0], 1), (5, [0.0, -1.0], 1)]
    got = run(spark, rows, 10)
    assert got == brute(rows, 10) and {r[1] for r in got} == {2}


def test_the_index_omits_rests():
    rng = np.random.default_rng(6)
    x = np.zeros((50, 32), np.float64)
    x[:, :16] = rng.integers(-99, 100, (50, 16))
    x[:, 16:] = rng.integers(-3, 4, (50, 16))
    segments = [slice(0, 16), slice(16, 32)]
    rest = N._rest_norms(x, segments)
    index = N.Index(x, segments, 20_000.0, rest.max(axis=0))
    assert len(index.postings[1]) == 0 < len(index.postings[0])
    i, j, score = N.pairs_over(index, x, rest, np.full(50, 20_000.0), segments)
    whole = x @ x.T
    assert sorted(zip(i, j, score)) == sorted((a, b, whole[a, b]) for a, b in zip(*np.nonzero(whole >= 20_000)))

import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from statedit.llm import ngram_join as N
from statedit.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {k: shingles(t) for k, t in docs}
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return sorted((k, len(s), root(k)) for k, s in sets.items())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    out = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "a b c d e"), (6, "x " * 5000)]
    for g in range(25):
        base = [word() for _ in range(rng.choice([8, 30, 90, 200]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.choice([1, 2, 6, 14])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.04, 0.1]))):
                copy[rng.randrange(len(copy))] = word()
            out.append((len(out) * 3 + 1000, " ".join(copy)))
    return out


def test_against_brute_force(spark, monkeypatch):
    for seed, per_row in ((1, 4), (2, 0)):
        if not per_row:  # many star rounds
            monkeypatch.setattr(N, "PAIRS_PER_ROW", 0)
            monkeypatch.setattr(N, "LEAST_PAIRS", 100)
        docs = corpus(seed)
        df = spark.createDataFrame([(k, t, k, "z") for k, t in docs], "doc_id long, text string, n long, ent string").repartition(3)
        got = sorted(tuple(r) for r in N.near_classes(df).collect())
        assert got == brute(docs)


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert N.near_classes(spark.createDataFrame([], schema)).count() == 0
    t = "a b c d e f g h"
    rows = N.near_classes(spark.createDataFrame([(9, t), (9, t), (None, t), (4, t.upper()), (None, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == [
        ("4", 4, "4"), ("9", 4, "4"), ("9", 4, "4"), ("None", 0, "None"), ("None", 4, "4")]


def test_stage_keeps_one_of_each_group(spark):
    docs = corpus(3)
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = N.stage(spark, df, "")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(docs)}


def test_stage_judges_rows_not_ids(spark):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    near = [*t[:-1], "end"]
    docs = [(1, t, "x"), (None, t, "copy without id"), (None, near, "near copy without id"), (7, ["own"] * 9, "y"), (7, near, "near copy under another id"),
            (None, ["single", "text"], "only one"), (None, ["single", "text"], "its copy"), (5, None, "null"), (5, None, "null")]
    df = spark.createDataFrame([(k, w and " ".join(w), n, 0) for k, w, n in docs], "doc_id long, text string, note string, `__node` int").repartition(3)
    kept = N.stage(spark, df, "")
    assert kept.columns == df.columns
    notes = sorted(r.note for r in kept.collect())
    one = [n for n in notes if n in ("its copy", "only one")]
    assert len(one) == 1 and [n for n in notes if n not in one] == ["null", "null", "x", "y"]


def test_groups_of_unlinked_members(spark, monkeypatch):
    """Many documents with rare shingles in common that do not link: centres double until all is compared."""
    monkeypatch.setattr(N, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(N, "LEAST_PAIRS", 5)
    monkeypatch.setattr(N, "SINGLE_CENTRE_ROUNDS", 1)
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(40)]
    docs = [(k, " ".join([*shared, *(f"g{k // 4}w{i}" for i in range(rng.choice([9, 16, 30])))])) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in N.near_classes(df).collect()) == brute(docs)


def test_members_that_are_alike_but_do_not_link_are_not_counted(spark, monkeypatch):
    """Copies of one text, each edited so much that hardly two of them link: their sets do not meet pair by pair."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for k in range(80):
        copy = list(base)
        for i in rng.sample(range(150), 5):
            copy[i] = f"e{k}.{i}"
        docs.append((k, " ".join(copy)))
    overlaps, made = N.overlaps, []
    monkeypatch.setattr(N, "overlaps", lambda pairs, *rest: made.append(pairs.count()) or overlaps(pairs, *rest))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs)
    for per_row, least, single in ((N.PAIRS_PER_ROW, N.LEAST_PAIRS, N.SINGLE_CENTRE_ROUNDS), (0, 5, 1)):
        monkeypatch.setattr(N, "PAIRS_PER_ROW", per_row)
        monkeypatch.setattr(N, "LEAST_PAIRS", least)
        monkeypatch.setattr(N, "SINGLE_CENTRE_ROUNDS", single)
        made.clear()
        assert sorted(tuple(r) for r in N.near_classes(df).collect()) == want
        assert sum(made) < 600, made  # of 3160 pairs


def test_differing_bits_are_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n, keep in ((0, 0), (1, 1), (60, 60), (60, 55), (70, 60), (300, 0), (300, 270), (3000, 2900), (40_000, 36_000)):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        b = np.unique(np.concatenate((a[:keep], rng.integers(0, 1 << 64, n // 20, np.uint64))))
        rows.append((_ints(N._parity(a)), _ints(N._parity(b))))
        want.append(len(np.setxor1d(a, b)) if len(a) * 8 <= len(b) * 10 and len(b) * 8 <= len(a) * 10 else None)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").coalesce(1)
    assert len(rows[3][0]) == len(rows[3][1]) == 8 and len(rows[4][0]) == 16 > len(rows[2][0])
    for r, most in zip(df.select(N._differing(F.col("a"), F.col("b")), N._differing(F.col("b"), F.col("a"))).collect(), want):
        assert r[0] == r[1]
        assert most is None or 0.6 * most <= r[0] <= most
    wide, narrow = _ints(N._parity(np.arange(70, dtype=np.uint64))), _ints(N._parity(np.arange(60, dtype=np.uint64)))
    assert spark.createDataFrame([(wide, narrow)], "a array<long>, b array<long>").select(N._differing(F.col("a"), F.col("b"))).first()[0] == 10


def _ints(x):
    return [int(i) for i in x]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 8), (7, 9), (5, 1), (20, 21), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    assert got == want


class Caught:
    """Stands for a DataFrame and gives the function that its tasks run."""

    def mapInArrow(self, run, schema):
        return run


def test_a_task_of_the_filter_is_small():
    """Entries of the filter are dealt to fragments without whole copies beside them."""
    rng = random.Random(2)
    texts = [" ".join(str(rng.random())[2:8] for _ in range(2000)) for _ in range(600)]
    batch = pa.record_batch({"doc_id": pa.array(range(600)), "text": texts})
    run = N._fragments(Caught(), 5, 80, 40, 64)
    entries, runs = 0, 0
    tracemalloc.start()
    for out in run(iter([batch])):
        for fragment, h, packed in zip(*(c.to_pylist() for c in out.columns)):
            if fragment is not None:
                h, pairs = np.frombuffer(h, np.uint64), np.frombuffer(packed, np.int64).reshape(-1, 2)
                assert pairs[:, 1].sum() == len(h)
                entries, runs = entries + len(h), runs + 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 450_000 < entries < 500_000 and runs >= 40
    assert peak < 35 * entries, peak / entries


def test_unwanted_rows_are_dropped_by_the_worker_that_hashes():
    batch = pa.record_batch({"doc_id": pa.array([1, None, 3]), "text": ["a b", "c d", "e"], "p": pa.array([0, 1, 1])})
    run = N.shingle_sets(Caught(), 5, True, lambda b: b.column(2).to_numpy() == 1)
    assert [r["doc_id"] for out in run(iter([batch])) for r in out.to_pylist()] == [None, 3]

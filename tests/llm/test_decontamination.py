import random
import re

import pytest
from pyspark.sql import functions as F

from statedit.llm import decontamination as D

DOC = "doc_id long, text string, item_id string, windows string"


def tokens(text):
    t = (text or "").replace("\x01", " ")
    t = re.sub(r"(?<=[^\s.!?:;] )([A-ZÀ-Þ][a-zß-ÿ]+)(?![^\W_])", "\x01N\\1", t)
    t = re.sub(r"(?<![^\W_])(?<!\x01)(\d+(?:[.,:/]\d+)*)", "\x01D\\1", t)
    t = re.sub(r"(?i)(\x01D[\d.,:/]*\d)\s*(" + "|".join(D.UNITS) + r")(?![^\W_])", "\\1 \x01U\\2", t)
    t = re.sub(r"[^\w\s\x01.,:/]+|_", "", t.lower())
    t = re.sub(r"[.,:/](?!\d)|(?<!\d)[.,:/]", "", t)
    return t.split()


def brute(docs, items):
    shape = lambda t: tuple(x[:2] if x[0] == "\x01" else x for x in t)
    out = set()
    for d, text in docs:
        a = tokens(text)
        for i, itext in items:
            b = tokens(itext)
            starts = [p for p in range(len(b) - 7) if sum(x[0] != "\x01" for x in b[p:p + 8]) >= 4]
            for at in range(-len(b), len(a)):
                hit = [p for p in starts if at + p >= 0 and shape(a[at + p:at + p + 8]) == shape(b[p:p + 8])]
                if starts and hit and len(hit) >= 0.5 * len(starts):
                    lo, hi = hit[0], hit[-1] + 8
                    pairs = {(x, y) for x, y in zip(b[lo:hi], a[at + lo:at + hi]) if x[0] == "\x01" == y[0]}
                    if len(pairs) == len({x for x, _ in pairs}):
                        out.add((d, i, len(hit)))
    return out


ITEM = "A farmer named Bob walks 12 km in 3 hours while the other farmer Alice rides 40 km; how far does Bob walk in one day"


def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    items = [(1, ITEM), (2, " ".join(word() for _ in range(30))), (3, "too short"), (4, None), (5, ""), (2, " ".join(word() for _ in range(20)))]
    fill = lambda n: " ".join(word() for _ in range(n))
    other = ITEM.replace("Bob", "Jim").replace("12", "7.5").replace("Alice", "Eve")
    torn = ITEM.replace("Bob", "Jim", 1)
    docs = [(10, fill(40) + " " + ITEM + " " + fill(30)), (11, other + ". " + fill(9)), (12, fill(5) + " " + torn), (13, fill(200)), (14, None), (15, ""),
            (16, fill(9) + " " + items[1][1].upper() + "!"), (17, " ".join(items[1][1].split()[:25])), (18, " ".join(items[1][1].split()[:14])),
            (19, "1 2 3 4 5 6 7 8 9 10 " * 30), (20, fill(3) + " " + items[5][1]), (21, "the " * 50_000)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in docs + docs[:2]], DOC).repartition(4)
    bench = spark.createDataFrame([(a, b, "z") for a, b in items + items[:1]], "item_id long, text string, doc_id string")
    for text, in {(t,) for _, t in docs[:13] + items}:
        assert spark.range(1).select(D.typed_tokens(F.lit(text))).first()[0] == tokens(text)
    got = {(r.doc_id, r.item_id, r.windows): r for r in D.find_leaks(df, bench).collect()}
    want = brute(docs[:-1], items)
    best = {(d, i): max(w for x, y, w in want if (x, y) == (d, i)) for d, i, _ in want}
    assert set(got) == {(d, i, w) for (d, i), w in best.items()}
    assert {k[0] for k in got} >= {10, 11, 16, 17, 20} and not {k[0] for k in got} & {12, 13, 14, 15, 18, 19, 21}
    assert {k[0]: r.changed for k, r in got.items() if k[1] == 1} == {10: 0, 11: 4}


def test_empty_tables_and_null_ids(spark):
    docs, items = corpus()
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.find_leaks(none, bench).count() == 0
    df = spark.createDataFrame([(None, docs[0][1]), (None, docs[3][1])], "doc_id long, text string")
    assert D.find_leaks(df, bench.limit(0)).count() == 0
    assert [(r.doc_id, r.item_id) for r in D.find_leaks(df, bench).collect()] == [(None, 1)]


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="no test data here")
def test_planted_items_go_and_others_stay(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    planted = {r.doc_id for r in docs.collect() if any(i in r.text for i in items)}
    kept = D.stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == planted


def test_short_items_as_they_are(spark):
    items = [(1, "What is the capital of France?"), (2, "12 34 56 78 90 11 22 33 44 55"), (3, "Yes"), (4, None), (None, "so it goes on")]
    docs = [(1, "He asked: what is the CAPITAL of France? Nobody knew."), (2, "See 12 34 56 78 90 11 22 33 44 55 there."),
            (3, "See 12 34 56 78 90 11 22 33 44 56 there."), (4, "What is the capital of Norway?"), (5, "Yes"), (None, "And so it goes on and on."), (6, None)]
    d = spark.createDataFrame([(*r, 0) for r in docs + docs[:1]], "doc_id long, text string, n int")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, n int")
    got = sorted((str(r.doc_id), str(r.item_id), r.windows, r.item_windows, r["at"], r.changed) for r in D.find_leaks(d, b).collect())
    assert got == [("1", "1", 1, 1, 2, 0), ("2", "2", 1, 1, 1, 0), ("None", "None", 1, 1, 1, 0)]
    assert D.find_leaks(d, b.limit(0)).count() == 0

import math
import random
import re
from collections import Counter

from statedit.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, item string"
ITEMS = "item_id long, text string, doc_id long"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(k, Counter(terms(t))) for k, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item in sorted({i for i, _ in items}, key=str):
        asked = [t for text in {x for i, x in items if i == item} for t in terms(text)]
        scored = []
        for k, b in bags:
            if b:
                m = 25 + 75 * sum(b.values()) * n_docs // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m))
                        for t in asked if b[t])
                if s > 0:
                    scored.append((-s, k is None, k))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, k, -s) for r, (s, _, k) in enumerate(scored[:top])]
    return out


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(k, t, 0, "x") for k, t in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(k, t, 1) for k, t in items], ITEMS)
    got = [tuple(r) for r in S.search(d, i, **options).collect()]
    return sorted(got, key=lambda r: (str(r[0]), r[1]))


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcéÆ0", k=rng.randint(1, 9))) for _ in range(60)]
    docs = []
    for k in range(120):
        text = rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(words, k=rng.choice([1, 3, 20, 200])))
        docs.append((1000 - k, text.upper() if k % 5 == 0 else text))
    docs += [(2000 + k, docs[7][1]) for k in range(25)] + [(3000 - k, docs[9][1] + " .") for k in range(15)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(9)]
    return docs, items + [(20, docs[7][1]), (21, "none of these"), (22, "a a a b b")]


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = corpus(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_slices_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_BYTES", 64)
    monkeypatch.setattr(S, "CELLS", 8)
    docs, items = corpus(3)
    docs.append((5000, " ".join(t for _, t in docs)))
    assert run(spark, docs, items, slice_bytes=40, top=4) == brute(docs, items, 4)


def test_nulls_ties_and_empty_tables(spark):
    docs = [(None, "x y"), (3, "x y"), (3, "x y"), (2, "Y x"), (1, None), (4, ""), (5, "z " * 50), (6, "...")]
    items = [(1, "x"), (1, "x"), (2, None), (None, "z"), (3, "q"), (4, ""), (5, "x"), (5, "y")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert [r[2] for r in got if r[0] == 1] == [2, 3, 3, None]
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_equal_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(S, "word_hashes", lambda data, starts, ends: (ends - starts).astype("uint64"))
    import numpy as np

    vocab = S.Vocabulary([b"ab", b"cd", b"abc", b"x"])
    data = np.frombuffer(b"cd ab zz abc abd x", np.uint8)
    assert vocab.find(data, *S.term_spans(data)).tolist() == [1, 0, -1, 2, -1, 3]

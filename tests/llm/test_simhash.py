import hashlib
import random
from collections import Counter

import numpy as np

from statedit.llm import simhash as H

SCHEMA = "doc_id long, text string, fingerprint string, n_chars string"


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefé", k=rng.randint(1, 5)))
    rows = [(i * 7, " ".join(word() for _ in range(rng.choice([0, 1, 3, 5, 80, 400])))) for i in range(200)]
    rows += [(5000 + i, rows[-1][1]) for i in range(5)]
    return rows + [(3, None), (1, ""), (2, "long word " * 20_000)]


def neighbours(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return [(k, t or "", order[(i + 1) % len(order)][1] or "") for i, (k, t) in enumerate(order)]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], SCHEMA).repartition(7)
    got = {r.doc_id: r for r in H.compare_neighbours(df).collect()}
    assert len(got) == len(rows)
    unit = lambda t: H.fingerprints([t.encode()])[0]
    for k, text, following in neighbours(rows):
        n = len(text)
        changed = text[:n - n // 2] + following[:n // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == unit(text).tobytes().hex() and r.edited_fingerprint == unit(changed).tobytes().hex()
        assert abs(r.near_edited - H.likeness(unit(text), unit(changed))) < 1e-12
        assert abs(r.near_next - H.likeness(unit(text), unit(following))) < 1e-12 and 0 <= r.near_next <= 1
    long = [r for r in got.values() if 300 < r.n_chars < 10_000]
    assert min(r.near_edited for r in long) > 0.2 and sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_likeness_follows_the_cosine():
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(1000)]
    for share, want in ((0, 1.0), (0.25, 0.75), (0.5, 0.5), (1, 0.0)):
        other = base[:int(1000 * (1 - share))] + [str(rng.random()) for _ in range(int(1000 * share))]
        a, b = H.fingerprints([" ".join(base).encode(), " ".join(other).encode()], 512)
        assert abs(float(H.likeness(a, b)) - want) < 0.15


def test_odd_tables(spark):
    assert H.compare_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    one = H.compare_neighbours(spark.createDataFrame([(4, "abcd", "", "")], SCHEMA)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest(), 1.0)]
    odd = [(None, "x y", "", ""), (None, None, "", ""), (4, "a b", "", ""), (4, "a b", "", ""), (4, "c", "", "")]
    got = H.compare_neighbours(spark.createDataFrame(odd, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter({(None, 3): 1, (None, 0): 1, (4, 3): 2, (4, 1): 1})


def test_search_finds_all_within_the_radius(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 256, (12, 16), dtype=np.uint8)
    prints = list(centre)
    for c in centre:
        for _ in range(25):
            bits = np.unpackbits(c)
            bits[rng.choice(128, rng.integers(0, 6), replace=False)] ^= 1
            prints.append(np.packbits(bits))
    texts = [p.tobytes().hex() for p in prints]
    want = {(a, b): d for a in set(texts) for b in set(texts) if a < b
            for d in [bin(int(a, 16) ^ int(b, 16)).count("1")] if d <= 3}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "fingerprint string")
    for crowd in (200, 3):
        monkeypatch.setattr(H, "CROWD", crowd)
        assert {(r.a, r.b): r.distance for r in H.near_links(df).collect()} == want and want
    assert H.near_links(df.limit(0)).count() == 0

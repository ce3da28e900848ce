import itertools
import random

from pyspark.sql import functions as F

from statedit.llm import url_filter as U


def tokens(url):
    if url is None or "://" not in url:
        return set()
    scheme, rest = url.split("://", 1)
    head = rest.split("#")[0]
    before, _, query = head.partition("?")
    host, slash, path = before.partition("/")
    host = host.lower()
    if not host:
        return set()
    labels = host.split(".")
    out = {"scheme:" + scheme.lower()} | {"host:" + ".".join(labels[i:]) for i in range(len(labels))}
    out |= {"path:" + s.lower() for s in path.split("/") if s}
    return out | {"query:" + q.split("=")[0].lower() for q in query.split("&") if q.split("=")[0]}


def corpus(n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        host = rng.choice(["a.example.com", "b.example.net", "shop.test", "www.shop.test"])
        path = rng.choice(["/win/prize", "/news", "/win", "/en/1"])
        query = rng.choice(["", "?ref=1", "?utm=2&ref=3"])
        bad = path.startswith("/win") and "shop" in host or rng.random() < 0.03
        rows.append((i, f"https://{host}{path}{query}", bad))
    return rows


def test_rules_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in U.mine_rules(df, min_support=0.1).collect()}
    sets = [(tokens(u), b) for _, u, b in rows]
    base = sum(b for _, b in sets) / len(sets)
    every = sorted(set().union(*(t for t, _ in sets)))
    want = {}
    for k in range(1, 6):
        for c in itertools.combinations(every, k):
            fit = [b for t, b in sets if t.issuperset(c)]
            if fit and sum(fit) >= 0.1 * len(sets) and sum(fit) / len(fit) >= U.MIN_CONFIDENCE and sum(fit) / len(fit) / base >= U.MIN_LIFT:
                want[c] = (round(sum(fit) / len(fit), 9), round(sum(fit) / len(sets), 9))
    assert got.keys() >= want.keys() and {c: got[c] for c in want} == want and want
    assert all(len(c) > 5 for c in got.keys() - want.keys())

    rules = U.mine_rules(df, min_support=0.1)
    judged = {r.page_id: r for r in U.judge_urls(df, rules, fixed=()).collect()}
    for i, url, _ in rows:
        best = max((v[0] for c, v in got.items() if tokens(url).issuperset(c)), default=None)
        assert judged[i].verdict == ("allow" if best is None else "block")
        assert best is None or round(judged[i].confidence, 9) == best


def test_hosts_paths_and_fixed_rules(spark):
    cases = [
        (1, None, "", "", None, "allow"), (2, "no scheme/x", "", "", None, "allow"), (3, "", "", "", None, "allow"),
        (4, "http://WWW.Example.ORG/es/A?x#y", "www.example.org", "/es/A", "example.org/es/", "block"),
        (5, "https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (6, "https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        (7, "https://example.org", "example.org", "", None, "allow"), (8, "https://notexample.org#/es/", "notexample.org", "", None, "allow"),
        (9, "ftp://x.com/de/://y", "x.com", "/de/://y", "com/de/", "block"), (10, "a://com/fr/", "com", "/fr/", "com/fr/", "allow"),
        (11, "a\nb://q.com?u=/de/", "q.com", "", None, "allow"), (None, "x:///p", "", "/p", None, "allow"),
        (12, "h://xorg/" + "z" * 50_000, "xorg", "/" + "z" * 50_000, None, "allow"),
    ]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b, *_ in cases + cases[:2]], "page_id long, url string, host string, tokens string")
    none = spark.createDataFrame([], "anchor string, tokens array<string>, confidence double, support double, lift double")
    got = U.judge_urls(df, none).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(a, *rest) for a, _, *rest in cases + cases[:2]]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.url: set(r.t) for r in df.select("url", U.url_tokens(F.col("url")).alias("t")).collect()} == {c[1]: tokens(c[1]) for c in cases}


def test_nothing_to_learn(spark):
    schema = "page_id long, url string, bad boolean"
    empty = spark.createDataFrame([], schema)
    assert U.mine_rules(empty).count() == 0 and U.judge_urls(empty, U.mine_rules(empty)).count() == 0
    assert U.mine_rules(spark.createDataFrame([(1, None, True), (2, "http://a.b/", None)], schema)).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c", True), (2, "http://d.e/", False)], schema)
    verdicts = U.judge_urls(one, U.mine_rules(one), fixed=()).select("page_id", "verdict").collect()
    assert sorted(map(tuple, verdicts)) == [(1, "block"), (2, "allow")]

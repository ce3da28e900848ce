import random
import zlib
from collections import Counter, defaultdict

from statedit.llm import sharding as S

SCHEMA = "doc_id long, text string, lang string, source string, size long, shard string"


def corpus(n=3000):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices("abé ", k=rng.choice([5, 60, 300]))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 9)}", 1, "x") for i in range(n)]
    rows += [(n + i, "same text " * 3, "en", f"s{i % 4}", 1, "x") for i in range(40)]
    return rows + [(-1, None, None, None, None, None), (-2, "", None, None, None, None), (-3, "z" * 1500, "fr", "q", 1, "x")]


def test_balance_groups_and_slots(spark):
    rows = corpus()
    got = S.shard(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert Counter(r.doc_id for r in got) == Counter(texts.keys())
    slots, size, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[texts[r.doc_id]].add(r.shard)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) < 1.1 * min(size.values())
    assert all(len(s) == 1 for s in where.values())


def test_hot_group_is_split(spark):
    rows = [(i, "hot text", "en", "s", 1, "x") for i in range(3000)] + [(3000 + i, f"other {i:05d}", "en", "s", 1, "x") for i in range(3000)]
    size = Counter()
    for r in S.shard(spark.createDataFrame(rows, SCHEMA)).collect():
        size[r.shard] += r.size
    assert len(size) == 16 and max(size.values()) < 1.15 * min(size.values())


def test_whole_groups_and_odd_numbers(spark):
    """Groups of most of a shard stay whole, beside others; the shards are equal, and need not be a power of two."""
    rows = [(i, "g" * 99 + str(i % 2), "en", "s", 1, "x") for i in range(130)]  # two groups of 0.65 shard each
    rows += [(1000 + i, f"{i:09d}", "en", f"s{i % 3}", 1, "x") for i in range(8700)]
    for shards in (10, 7, 1):
        size, where = Counter(), defaultdict(set)
        for r in S.shard(spark.createDataFrame(rows, SCHEMA), shards).collect():
            size[r.shard] += r.size
            where[r.text_crc32].add(r.shard)
        assert len(size) == shards and max(size.values()) < 1.05 * min(size.values())
        assert all(len(s) == 1 for s in where.values())


def test_pieces_do_not_depend_on_ids(spark):
    """A group of a third of all bytes whose rows have no id, or all the same."""
    rows = [(None if i % 2 else 4, "hot text", "en", "s", 1, "x") for i in range(2000)] + [(i, f"other {i:05d}", "en", "s", 1, "x") for i in range(2000)]
    size = Counter()
    for r in S.shard(spark.createDataFrame(rows, SCHEMA)).collect():
        size[r.shard] += r.size
    assert len(size) == 16 and max(size.values()) < 1.2 * min(size.values())


def test_small_tables(spark):
    assert S.shard(spark.createDataFrame([], SCHEMA)).count() == 0
    got = S.shard(spark.createDataFrame([(None, None, None, None, 1, ""), (None, None, None, None, 1, ""), (5, "a" * 300_000, "x", "y", 1, "")], SCHEMA)).collect()
    assert len(got) == 3 and all(0 <= r.shard < 16 for r in got)


def test_median_tree_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(i, float(rng.randint(0, 50)), float(rng.randint(0, 9)), rng.randint(1, 30)) for i in range(200)]
    total = sum(p[3] for p in points)
    span = [max(p[k] for p in points) - min(p[k] for p in points) for k in (1, 2)]

    def tree(ps, depth):
        weight = sum(p[3] for p in ps)
        if not depth or len(ps) < 2 or weight <= S.CUT_OVER * total / 8:
            return [sorted(p[0] for p in ps)]
        widths = [(max(p[k] for p in ps) - min(p[k] for p in ps)) / span[k - 1] for k in (1, 2)]
        k = 1 + widths.index(max(widths))
        run, left, right = 0, [], []
        for p in sorted(ps, key=lambda p: (p[k], p[0])):
            run += p[3]
            (right if run - p[3] / 2 > weight / 2 else left).append(p)
        return [x for part in (left, right) if part for x in tree(part, depth - 1)]

    df = spark.createDataFrame(points, "id long, x double, y double, w long")
    found = defaultdict(list)
    for r in S.kd_leaves(df, ["x", "y"], "w", ["id"], total / 8, 3).collect():
        found[r.leaf].append(r.id)
    assert [sorted(found[k]) for k in sorted(found)] == tree(points, 3)

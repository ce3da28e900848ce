import json
import random

import pytest

from statedit.operators import rules as R
from statedit.operators.upsert import insert_new, replace_scope, upsert
from statedit.plans.rule_run import run_rules_for_changes, run_rules_for_period, run_rules_for_submission

RULES = [R.SumRule("total", "income", "sum", (("a", 1), ("b", -1)), 1000), R.SumRule("part", "income", "a", (("c", 1),), 0)]


def ledger(spark, data):
    return spark.createDataFrame(data, "seq long, account string, amount string")


@pytest.mark.parametrize(("amounts", "value"), [
    ({"sum": "5000", "a": "6000", "b": "1000"}, None),
    ({"sum": "6000", "a": "6000", "b": "1000"}, None),
    ({"sum": "6001", "a": "6000", "b": "1000"}, 1001.0),
    ({"sum": "3000", "b": "1000"}, 4000.0),
    ({"sum": "3000", "a": "text", "b": None}, 3000.0),
    ({"a": "2000", "b": "0"}, -2000.0),
])
def test_threshold(spark, amounts, value):
    df = ledger(spark, [(1, k, v) for k, v in amounts.items()])
    hits = R.evaluate_sum_rules(df, R.rule_terms(spark, RULES[:1])).collect()
    assert [r.value for r in hits] == ([] if value is None else [value])


def test_long_form_equals_wide_form(spark, rows):
    rng = random.Random(5)
    accounts = ["sum", "a", "b", "c"]
    data = [
        (s, a, rng.choice([None, "x", str(rng.randint(-3000, 3000)), f"{rng.randint(0, 3000)}.25"]))
        for s in range(200) for a in accounts if rng.random() < 0.8
    ]
    def number(s, a):
        for seq, account, amount in data:
            if (seq, account) == (s, a):
                try:
                    return float(amount)
                except (TypeError, ValueError):
                    return 0.0
        return 0.0
    expected = []
    for s in range(200):
        for r in RULES:
            diff = number(s, r.lhs) - sum(sign * number(s, a) for a, sign in r.terms)
            if abs(diff) > r.threshold:
                expected.append((r.control_id, s, True, diff))
    assert rows(R.evaluate_sum_rules(ledger(spark, data), R.rule_terms(spark, RULES))) == sorted(expected)


def test_one_shuffle_and_a_broadcast(spark, plan):
    df = ledger(spark, [(1, "a", "1")]).repartition(3)
    text = plan(R.evaluate_sum_rules(df, R.rule_terms(spark, RULES)))
    assert "BroadcastHashJoin" in text and "partial_sum" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_rule_tables(spark, tmp_path, rows):
    with pytest.raises(ValueError):
        R.rule_terms(spark, [R.SumRule("x", "t", "a", (), -1)])
    path = tmp_path / "rules.json"
    path.write_text("\n".join(json.dumps({
        "control_id": r.control_id, "theme": r.theme, "category": r.category, "description": "", "lhs": r.lhs,
        "threshold": r.threshold, "terms": [{"account": a, "sign": s} for a, s in r.terms],
    }) for r in RULES), encoding="utf-8")
    columns = ("control_id", "account", "coef", "threshold")
    assert rows(R.read_rules(spark, str(path)), *columns) == rows(R.rule_terms(spark, RULES), *columns)
    rule = R.section_rule("s", "income", "sumX", ["3000", "3300", "4000", "sumX"], 3000, 3999, contra=["3300"])
    assert rule.terms == (("3000", 1), ("3300", -1))


def test_touching(spark, rows):
    terms = R.rule_terms(spark, RULES)
    assert rows(R.rules_touching(terms, ["a"])) == [("part",), ("total",)]
    assert rows(R.rules_touching(terms, ["c", "zzz"])) == [("part",)]


def versions(spark):
    return spark.sql("""
        SELECT * FROM VALUES ('u1', 2024, 1L, 1, timestamp_ntz'2024-01-01 00:00:00'), ('u1', 2024, 2L, 2, timestamp_ntz'2024-02-01 00:00:00'),
                             ('u2', 2023, 3L, 1, timestamp_ntz'2023-01-01 00:00:00') AS t(unit, period, seq, version_no, received_at)""")


STORED = "period int, control_id string, seq long, unit string, hit boolean, value double, sector string"


def test_runs_replace_their_own_scope(spark, rows):
    book = ledger(spark, [(s, k, v) for s in (1, 2, 3) for k, v in (("sum", str(9000 * s)), ("a", "1"))])
    terms, counts = R.rule_terms(spark, RULES), spark.sql("SELECT 1L AS seq, 2L AS n_changes")
    stored = spark.createDataFrame([
        (2024, "total", 2, "u1", True, -1.0, None), (2024, "other", 2, "u1", True, -1.0, None), (2023, "total", 3, "u2", True, -1.0, None),
    ], STORED)
    catalogue = spark.createDataFrame([(2024, "total", "old"), (2023, "total", "old")], "period int, control_id string, theme string")
    register = spark.sql("SELECT 'u1' AS unit, 'S1' AS sector")
    run = run_rules_for_period(stored, catalogue, versions(spark), counts, book, terms, 2024, "2025-01-01", register)
    assert rows(run.hits, "control_id", "seq", "value", "sector") == [
        ("other", 2, -1.0, None), ("part", 1, 1.0, "S1"), ("total", 1, 8999.0, "S1"), ("total", 3, -1.0, None)
    ]
    assert rows(run.catalogue) == [(2023, "total", "old"), (2024, "part", "income"), (2024, "total", "income")]
    one = run_rules_for_submission(stored, versions(spark), book, terms, 2)
    assert rows(one.hits, "control_id", "seq", "value") == [
        ("other", 2, -1.0), ("part", 2, 1.0), ("total", 2, 17999.0), ("total", 3, -1.0)
    ]
    changed = spark.sql("SELECT 2L AS seq, 'c' AS account UNION ALL SELECT 3L, 'sum'")
    some = run_rules_for_changes(stored, versions(spark), book, terms, changed)
    assert rows(some.hits, "control_id", "seq", "value") == [
        ("other", 2, -1.0), ("part", 2, 1.0), ("total", 2, -1.0), ("total", 3, 26999.0)
    ]


def test_rule_hits_order(spark):
    hits = spark.createDataFrame([(2024, "a", 1, "u", True, -9.0, None), (2024, "a", 2, "u", True, 3.0, None), (2023, "a", 3, "u", True, 1.0, None)], STORED)
    assert [r.seq for r in R.rule_hits(hits).collect()] == [1, 2, 3]
    assert [r.seq for r in R.rule_hits(hits, period=2024, control_id="a").collect()] == [1, 2]


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_upserts(spark, rows, request, plan, limit):
    """Both ways of joining: a batch too large to broadcast, and a small one."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit - 1)
    request.addfinalizer(lambda: spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before))
    old = spark.createDataFrame([(1, "a", 5, "k"), (1, None, 6, "k")], "seq int, account string, amount int, note string")
    new = spark.createDataFrame([(1, None, 7), (2, "a", 8)], "seq int, account string, amount int")
    assert rows(upsert(old, new, ["seq", "account"], ["amount"])) == [
        (1, None, 7, "k", "updated"), (1, "a", 5, "k", "untouched"), (2, "a", 8, None, "inserted")
    ]
    assert insert_new(old, new, ["seq", "account"]).count() == 3
    assert ("full_outer" in plan(upsert(old, new, ["seq", "account"], ["amount"])).replace("FullOuter", "full_outer")) == (limit == 0)
    emptied = replace_scope(old, old.where("false").select("note", "amount", "account", "seq"), old.select("seq"))
    assert emptied.count() == 0
    swapped = replace_scope(old, old.where("account = 'a'").select("note", "amount", "account", "seq"), old.where("account = 'a'").select("account"))
    assert rows(swapped) == rows(old)

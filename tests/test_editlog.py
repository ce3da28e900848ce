import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from statedit.operators import editlog as E

BASE = "id long, part string, amount long, price double, note string"


def entry(unit, variable, old, new, at):
    return {
        "statistics_name": "s", "data_source": ["x.parquet"], "data_target": E.TARGET_PLACEHOLDER, "data_period": "2024",
        "variable_name": variable, "change_event": "M", "change_event_reason": "REVIEW", "change_datetime": at,
        "changed_by": "me", "data_change_type": "UPD", "change_comment": "c",
        "change_details": {
            "detail_type": "unit",
            "unit_id": [{"unit_id_variable": k, "unit_id_value": str(v)} for k, v in unit.items()],
            "old_value": [{"variable_name": variable, "value": old}],
            "new_value": [{"variable_name": variable, "value": new}],
        },
    }


def make_log(spark, entries):
    df = spark.createDataFrame(entries, E.LOG_SCHEMA + ", seq long" if entries and "seq" in entries[0] else E.LOG_SCHEMA)
    return df


def text(value):
    return "None" if value is None else str(value)


def sequential(base, edits):
    """Replay one edit after the other: the plain meaning of a log."""
    state = {(r["id"], r["part"]): dict(r) for r in base}
    for unit, variable, old, new in edits:
        row = state[unit["id"], unit["part"]]
        if old == "None":
            if row[variable] is None:
                row[variable] = None if new == "None" else type_of(variable)(new)
        else:
            assert type_of(variable)(old) == row[variable]
            row[variable] = None if new == "None" else type_of(variable)(new)
    return state


def type_of(variable):
    return {"amount": int, "price": float, "note": str}[variable]


def random_edits(rng, base, n):
    """Valid edits with nulls, no-ops and long chains on one hot cell."""
    state = {(r["id"], r["part"]): dict(r) for r in base}
    edits = []
    for _ in range(n):
        key = (1, "a") if rng.random() < 0.4 else rng.choice(list(state))
        variable = "amount" if key == (1, "a") and rng.random() < 0.8 else rng.choice(["amount", "price", "note"])
        now = state[key][variable]
        new = rng.choice([None, rng.randint(0, 9)])
        new = None if new is None else type_of(variable)(new)
        if now is None or rng.random() < 0.25:
            old = "None"
            if now is None:
                state[key][variable] = new
        else:
            old = text(now)
            state[key][variable] = new
        edits.append(({"id": key[0], "part": key[1]}, variable, old, text(new)))
    return edits


@pytest.mark.parametrize(("seed", "step"), [(1, timedelta(seconds=0)), (2, timedelta(minutes=7)), (3, timedelta(hours=5))])
def test_replay_equals_sequential_replay(spark, seed, step):
    rng = random.Random(seed)
    base = [
        {"id": i, "part": p, "amount": rng.choice([None, i]), "price": rng.choice([None, i / 2]), "note": rng.choice([None, "n"])}
        for i in range(1, 6) for p in "ab"
    ]
    edits = random_edits(rng, base, 150)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log = [{**entry(u, v, o, n, start + step * i), "seq": i} for i, (u, v, o, n) in enumerate(edits)]
    rng.shuffle(log)
    table = spark.createDataFrame([tuple(r[c] for c in ("id", "part", "amount", "price", "note")) for r in base], BASE)
    edited = E.apply_log(table, make_log(spark, log), ["id", "part"])
    got = {(r.id, r.part): r.asDict() for r in edited.collect()}
    assert got == sequential(base, edits)
    assert edited.schema == table.schema


def one_cell(spark, old, new, **kw):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    base = spark.createDataFrame([(1, 10), (2, 40), (3, 80)], "id long, value long")
    return base, make_log(spark, [entry({"id": kw.get("id", 1)}, kw.get("variable", "value"), old, new, at)])


def test_apply_one_edit(spark, rows):
    base, log = one_cell(spark, "10", "20")
    assert rows(E.apply_log(base, log)) == [(1, 20), (2, 40), (3, 80)]


def test_empty_log_changes_nothing(spark, rows):
    base, log = one_cell(spark, "10", "20")
    assert rows(E.replay_log(base, log.where("false"), ["id"])[0]) == rows(base)


@pytest.mark.parametrize(("kw", "problem"), [
    ({"old": "11", "new": "20"}, "stale_old_value"),
    ({"old": "10", "new": "twenty"}, "bad_value"),
    ({"old": "10", "new": "20", "id": 9}, "unit_not_found"),
    ({"old": "10", "new": "20", "variable": "other"}, "unknown_variable"),
])
def test_problems(spark, kw, problem):
    base, log = one_cell(spark, kw.pop("old"), kw.pop("new"), **kw)
    assert [r.problem for r in E.replay_log(base, log, ["id"])[1].collect()] == [problem]
    with pytest.raises(ValueError):
        E.apply_log(base, log)


def test_key_that_is_not_unique(spark):
    base, log = one_cell(spark, "10", "20")
    twice = base.unionByName(base.where("id = 1"))
    assert [r.problem for r in E.replay_log(twice, log, ["id"])[1].collect()] == ["unit_not_unique"]


def test_old_none_on_a_filled_cell_does_nothing(spark, rows):
    base, log = one_cell(spark, "None", "20")
    assert rows(E.apply_log(base, log)) == rows(base)


def test_a_stale_edit_inside_a_chain(spark):
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    chain = [("10", "11"), ("11", "12"), ("99", "13"), ("13", "14")]
    log = make_log(spark, [entry({"id": 1}, "value", o, n, at + timedelta(minutes=40 * i)) for i, (o, n) in enumerate(chain)])
    base = spark.createDataFrame([(1, 10)], "id long, value long")
    found = E.replay_log(base, log, ["id"])[1].collect()
    assert [(r.expected, r.found) for r in found] == [("99", "12")]


def test_build_log(spark):
    edits = spark.createDataFrame(
        [({"orgnr": "971526920", "aar": 2024, "ansatte": 150}, "ansatte", 140, 150, 1764168184878, "REVIEW", "Te\nster")],
        "data struct<orgnr: string, aar: long, ansatte: long>, colId string, oldValue long, value long, timestamp long, "
        "reason string, comment string",
    )
    meta = {"statistics_name": "s", "data_source": "a.parquet", "data_period": "2024", "changed_by": "me"}
    row = E.build_log(edits, ["orgnr", "aar"], meta).select(F.to_json(F.struct("*"))).first()[0]
    log = json.loads(row)
    assert log["change_datetime"].startswith("2025-11-26T14:43:04.878")
    assert log["change_comment"] == "Tester" and log["change_event"] == "M" and log["data_change_type"] == "UPD"
    assert log["data_target"] == "data_target_placeholder" and log["data_source"] == ["a.parquet"]
    assert log["change_details"] == {
        "detail_type": "unit",
        "unit_id": [{"unit_id_variable": "orgnr", "unit_id_value": "971526920"}, {"unit_id_variable": "aar", "unit_id_value": "2024"}],
        "old_value": [{"variable_name": "ansatte", "value": "140"}],
        "new_value": [{"variable_name": "ansatte", "value": "150"}],
    }
    for bad in (edits.withColumn("comment", F.lit(" ")), edits.withColumn("reason", F.lit("WHIM"))):
        with pytest.raises(Exception, match="comment|reason"):
            E.build_log(bad, ["orgnr"], meta).collect()


def test_log_report(spark):
    _, log = one_cell(spark, "10", "20")
    r = E.log_report(log).first()
    assert (r.variable, r.unit, r.old_value, r.new_value, r.changed_by, r.change_comment) == ("value", "id=1", "10", "20", "me", "c")


def cells(unit, changes, at):
    one = entry(unit, changes[0][0], None, None, at)
    for part, k in (("old_value", 1), ("new_value", 2)):
        one["change_details"][part] = [{"variable_name": c[0], "value": c[k]} for c in changes]
    return one


def test_rows_with_several_cells(spark, rows):
    base = spark.createDataFrame([(1, "a", 5, 1.0, "x"), (2, "a", 6, 2.0, None)], BASE)
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log = make_log(spark, [
        cells({"id": 1, "part": "a"}, [("amount", "5", "7"), ("price", "1.0", "3.5"), ("amount", "7", "8")], at),
        cells({"id": 2, "part": "a"}, [("note", "None", "n"), ("amount", "6", "None")], at),
    ])
    out = E.apply_log(base, log, ["id", "part"])
    assert rows(out) == [(1, "a", 8, 3.5, "x"), (2, "a", None, 2.0, "n")]
    assert E.log_report(log).count() == 5
    uneven = cells({"id": 1, "part": "a"}, [("amount", "5", "7")], at)
    uneven["change_details"]["new_value"].append({"variable_name": "price", "value": "2"})
    with pytest.raises(ValueError, match="uneven_cells"):
        E.apply_log(base, make_log(spark, [uneven]), ["id", "part"])


def test_metadata_by_period_and_table(spark, rows):
    types = spark.createDataFrame(
        [(2023, "t", "a", "string"), (2024, "t", "a", "integer"), (2024, "u", "a", "integer"), (2024, "u", "b", "string")],
        "period int, table_name string, variable string, datatype string")
    edits = spark.createDataFrame([("r1", "a", "1", "2"), ("r1", "b", "x", "y")], "ref string, variable string, old_value string, value string")
    out = E.edit_values(observations(spark), edits, ["ref"], types)
    assert rows(out, "ref", "variable", "value") == [("r1", "a", "2"), ("r1", "b", "y"), ("r2", "a", None)]
    torn = types.unionByName(spark.createDataFrame([(2024, "w", "a", "string")], types.schema))
    with pytest.raises(Exception, match="Contradicting metadata"):
        E.edit_outcomes(observations(spark), edits, ["ref"], torn).collect()
    assert E.edit_outcomes(observations(spark), edits, ["ref"], torn, table_name="u").where("outcome = 'updated'").count() == 2


LONG = "period int, unit string, ref string, variable string, value string"


def observations(spark):
    return spark.createDataFrame([(2024, "u1", "r1", "a", "1"), (2024, "u1", "r1", "b", "x"), (2024, "u2", "r2", "a", None)], LONG)


def test_edit_values_long(spark, rows):
    types = spark.createDataFrame([("a", "integer"), ("b", "string")], "variable string, datatype string")
    edits = spark.createDataFrame([
        (2024, "u1", "r1", "a", "1", "2"), (2024, "u1", "r1", "b", "y", "z"), (2024, "u2", "r2", "a", None, "1.5"),
        (2024, "u3", "r3", "a", None, "7"), (2024, "u4", "r4", "b", "q", "q"),
        (2024, "u5", "r5", "a", None, "1"), (2024, "u5", "r5", "a", None, "2"),
    ], "period int, unit string, ref string, variable string, old_value string, value string")
    judged = E.edit_outcomes(observations(spark), edits, ["ref"], types, insert_missing=True)
    assert {(r.ref, r.variable, r.outcome, r.reason) for r in judged.collect()} == {
        ("r1", "a", "updated", None), ("r1", "b", "rejected", "old value differs"), ("r2", "a", "rejected", "datatype float"),
        ("r3", "a", "inserted", None), ("r4", "b", "unchanged", None), ("r5", "a", "rejected", "several edits for one cell"),
    }
    out = E.edit_values(observations(spark), edits, ["ref"], types, insert_missing=True)
    assert rows(out, "ref", "variable", "value") == [("r1", "a", "2"), ("r1", "b", "x"), ("r2", "a", None), ("r3", "a", "7")]
    refused = E.edit_outcomes(observations(spark), edits.where("ref = 'r3'"), ["ref"], types)
    assert refused.first().reason == "no such row"


def test_edit_values_wide(spark, rows):
    table = spark.createDataFrame([("r1", 1, "x"), ("r2", 2, "y")], "ref string, a int, b string")
    edits = spark.createDataFrame([("r1", "a", "1", "5"), ("r2", "b", "y", None), ("r2", "a", "3", "4")],
                                  "ref string, variable string, old_value string, value string")
    assert rows(E.edit_values(table, edits, ["ref"], long=False)) == [("r1", 5, "x"), ("r2", 2, None)]


def test_editable(spark):
    edits = spark.createDataFrame([("value",), ("ref",), ("status",), ("extra",)], "column string")
    allowed = lambda kind, **k: [r.editable for r in E.editable(edits, kind, **k).collect()]
    assert allowed("long") == [True, False, False, False]
    assert allowed("wide") == [True, False, True, True]
    assert allowed("receipts") == [False, False, True, False]
    assert allowed("schema", columns=["extra"]) == [False, False, False, True]
    with pytest.raises(ValueError):
        E.editable(edits, "other")


def test_status(spark, rows):
    receipts = spark.createDataFrame(
        [("r1", "Ubehandlet", True), ("r2", "Ferdig", True), ("r3", "Ubehandlet", True)], "ref string, status string, active boolean"
    )
    edited = spark.createDataFrame([("r1",), ("r2",), ("r1",)], "ref string")
    assert rows(E.advance_status(receipts, edited), "ref", "status") == [
        ("r1", "Under arbeid"), ("r2", "Ferdig"), ("r3", "Ubehandlet")
    ]
    updates = spark.createDataFrame([("r2", None, False), ("r3", "Ferdig", None)], "ref string, status string, active boolean")
    assert rows(E.set_receipt_fields(receipts, updates)) == [
        ("r1", "Ubehandlet", True), ("r2", "Ferdig", False), ("r3", "Ferdig", True)
    ]
    with pytest.raises(ValueError):
        E.set_receipt_fields(receipts, updates.withColumn("unit", F.lit("x")))


def test_history(spark):
    changes = spark.sql("""
        SELECT * FROM VALUES ('r1', timestamp'2024-07-01 10:00:00.5', 'Altinn3'), ('r1', timestamp'2024-07-02 10:00:00', 'editering'),
                             ('r1', timestamp'2024-07-03 10:00:00', 'editering'), ('r2', timestamp'2024-07-03 10:00:00', 'editering')
        AS t(ref, changed_at, process_type)""")
    assert [r.changed_at for r in E.history(changes, "r1").collect()] == ["2024-07-03 12:00:00", "2024-07-02 12:00:00"]
    assert E.history(changes, "r1", hide_initial=False).count() == 3

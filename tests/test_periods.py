import pytest

from statedit.functions.periods import BY_YEAR, YEARLY, Spine
from statedit.operators import aggregates as A
from statedit.operators import controls as C
from statedit.operators import joins as J
from statedit.operators import latest as L

Q = Spine.regular(("year", "quarter"), (2022, 3), (2024, 2), 4)
RECEIPTS = "year int, quarter int, unit string, form string, ref string, received_at timestamp, active boolean"


def test_previous_and_labels():
    assert len(Q.periods) == 8
    assert Q.previous((2024, 1)) == (2023, 4) and Q.previous((2024, 1), BY_YEAR) == (2023, 1)
    assert Q.previous((2022, 3)) is None and Q.previous((2023, 2), BY_YEAR) is None
    assert Q.previous({"year": [2024], "quarter": 2, "form": "x"}, back=3) == (2023, 3)
    assert Q.label((2024, 2)) == "2024-2" and YEARLY.previous(2024) == (2023,) and YEARLY.previous([2024], BY_YEAR) == (2023,)
    for bad in (dict(columns=("a", "b")), dict(columns=("a",), periods=((2,), (1,))), dict(columns=("a",), periods=((1, 2),))):
        with pytest.raises(ValueError):
            Spine(**bad)
    with pytest.raises(ValueError):
        Q.period(2024)
    with pytest.raises(ValueError):
        Q.previous((2024, 1), "month")


def test_periods_of_a_table(spark, rows):
    df = spark.createDataFrame([(2023, 4, 1), (2023, 1, 2), (2023, 1, 3), (None, 1, 4), (2022, 2, 5)], "year int, quarter int, v int")
    spine = Spine.of(df, ["year", "quarter"])
    assert spine.periods == ((2022, 2), (2023, 1), (2023, 4)) and spine.previous((2023, 4)) == (2023, 1)
    assert rows(spine.following(df), "year", "quarter", "v") == [(2023, 1, 5), (2023, 4, 2), (2023, 4, 3)]
    assert rows(Q.following(df, BY_YEAR), "year", "quarter", "v") == [(2024, 1, 2), (2024, 1, 3)]
    assert rows(df.where(spine.is_in([(2023, 4), None])), "v") == [(1,)] and df.where(spine.is_in([None])).count() == 0
    assert Spine.of(df.limit(0), ["year"]).previous(3) == (2,) and Spine.of(df.limit(0), ["year", "quarter"]).previous((1, 1)) == (0, 0)


def test_pruning(spark, tmp_path, plan):
    path = str(tmp_path / "t")
    spark.createDataFrame([(y, q, 1) for y in (2022, 2023, 2024) for q in (1, 2, 3, 4)], "year int, quarter int, v int").write.partitionBy(
        "year", "quarter").parquet(path)
    df = spark.read.parquet(path).where(Q.is_in([(2024, 1), Q.previous((2024, 1))]))
    assert len({f.rsplit("/", 1)[0] for f in df.inputFiles()}) == 12 and df.count() == 2
    assert "PartitionFilters: [((" in plan(df)


@pytest.fixture(scope="module")
def tables(spark):
    import datetime

    at = lambda d: datetime.datetime(2024, 1, d)
    receipts = spark.createDataFrame([
        (2023, 4, "u", "A", "u1", at(1), True), (2024, 1, "u", "A", "u2", at(2), True), (2024, 1, "u", "A", "u0", at(1), True),
        (2023, 1, "w", "A", "w0", at(1), True), (2024, 1, "w", "A", "w1", at(1), True), (2023, 4, "x", "A", "x1", at(1), False),
    ], RECEIPTS)
    obs = spark.createDataFrame([
        (2023, 4, "A", "u", "u1", "v", "100"), (2024, 1, "A", "u", "u2", "v", "350"), (2024, 1, "A", "u", "u0", "v", "7"),
        (2023, 1, "A", "w", "w0", "v", "10"), (2024, 1, "A", "w", "w1", "v", "12"),
        (2023, 4, "A", "u", "u1", "t", "1"), (2024, 1, "A", "u", "u2", "t", "2"),
    ], "year int, quarter int, form string, unit string, ref string, variable string, value string")
    types = spark.createDataFrame([(2023, 4, "v", "int"), (2024, 1, "v", "int"), (2024, 1, "t", "string"), (2023, 4, "t", "int")],
                                  "year int, quarter int, variable string, datatype string")
    return receipts, obs, types


def test_totals_over_new_year(tables, rows):
    receipts, obs, types = tables
    out = A.period_totals(obs, receipts, types, (2024, 1), spine=Q)
    assert out.columns == ["variable", "2024-1", "2023-4", "diff", "pdiff"]
    # t was a number in 2023 and is text now: only its own period's metadata counts
    assert rows(out) == [("t", None, 1, None, -100.0), ("v", 362, 100, 262, 262.0)]
    by_year = A.period_totals(obs, receipts, types.where("variable = 'v'").drop("year", "quarter").distinct(), (2024, 1), spine=Q, by=BY_YEAR)
    assert rows(by_year) == [("v", 362, 10, 352, 3520.0)]
    assert A.period_totals(obs, receipts, types, (2022, 3), spine=Q).columns[2] == "previous"


def test_new_units_and_changes(tables, rows):
    receipts, obs, _ = tables
    assert rows(J.new_units(receipts, (2024, 1), Q), "ref", "hit") == [("u0", False), ("u2", False), ("w1", True)]
    assert rows(J.new_units(receipts, None, Q, BY_YEAR), "ref", "hit") == [
        ("u0", True), ("u1", True), ("u2", True), ("w0", True), ("w1", False), ("x1", True)]
    change = J.year_change(obs.where("variable = 'v'"), receipts, (2024, 1), Q)
    assert rows(change, "unit", "value", "previous_value", "diff") == [("u", "350", "100", 250.0), ("w", "12", None, 12.0)]


def test_controls_with_two_period_columns(tables, rows):
    receipts, obs, _ = tables
    ctx = C.ControlContext({"receipts": receipts, "observations": obs}, {"year": 2024, "quarter": 1}, options={"variable": "v"}, spine=Q)
    got = C.run_controls([C.new_unit, C.large_change, C.duplicate_submission], ctx)
    assert rows(got, "year", "quarter", "control_id", "ref", "hit", "value") == [
        (2024, 1, "duplicate_submission", "u0", True, 0), (2024, 1, "duplicate_submission", "u2", True, 0),
        (2024, 1, "duplicate_submission", "w1", False, 0), (2024, 1, "large_change", "u2", True, 250),
        (2024, 1, "new_unit", "u0", False, 0), (2024, 1, "new_unit", "u2", False, 0), (2024, 1, "new_unit", "w1", True, 0)]


def test_versions(spark, rows):
    import datetime

    v = spark.createDataFrame([("u", 2024, 1, 1, 1, datetime.datetime(2024, 1, 1), 0), ("u", 2024, 1, 2, 2, datetime.datetime(2024, 1, 2), 0),
                               ("u", 2023, 4, 3, 1, datetime.datetime(2023, 1, 1), 1)],
                              "unit string, year int, quarter int, seq long, version_no int, received_at timestamp, n_changes int")
    assert rows(L.comparable_versions(v, (2024, 1), Q), "seq", "label") == [
        (1, "v1 – 2024-01-01 00:00"), (2, "v2 – 2024-01-02 00:00"), (3, "2023-4")]


def test_catalogue_follows_a_changed_text(spark, rows):
    stored = C.register_controls(
        spark.createDataFrame([("2024", "new_unit", "I", "old text", "", "ASC", "mine")],
                              "period string, control_id string, kind string, description string, sort_by string, sort_order string, note string"),
        [C.new_unit, C.large_change], {"period": "2024"})
    assert rows(stored, "control_id", "description", "note") == [
        ("large_change", "Large change from the period before", None), ("new_unit", "Unit is new this period", "mine")]
    again = C.register_controls(stored, [C.new_unit, C.large_change], {"period": ["2024", "2025"]})
    assert again.count() == 4

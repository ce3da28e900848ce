import pytest
from pyspark.sql import functions as F

from statedit.functions import columns as C


def values(spark, inputs, expr, schema="x string"):
    df = spark.createDataFrame([(x,) for x in inputs], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_coerce_numeric(spark):
    texts = ["12", "12.9", "-3.7", "abc", "", None, "1e3", " 5 ", "NaN"]
    assert values(spark, texts, C.coerce_numeric("x")) == [12, 12, -3, None, None, None, 1000, 5, None]
    assert values(spark, ["x", None, "4"], C.coerce_numeric("x", 0)) == [0, 0, 4]


def test_clean_whitespace(spark):
    assert values(spark, [" 1 2\t3\n", None, ""], C.clean_whitespace("x")) == ["123", "", ""]


def test_org_number_status(spark):
    assert values(spark, ["979443137", "97944313", "97944313a", "", None], C.org_number_status("x")) == [
        "ok", "wrong_length", "not_digits", "missing", "missing"
    ]


def test_year_status(spark):
    assert values(spark, ["2024", "2026", "x", None, "2025"], C.year_status("x", 2024, 2025)) == [
        "ok", "out_of_range", "not_a_number", "missing", "ok"
    ]


def test_amount_status(spark):
    texts = ["1200", "1 200", "-5", "12.5", "", None, "999999999999", "1000000000000", "9" * 30]
    assert values(spark, texts, C.amount_status("x")) == [
        "ok", "ok", "ok", "not_an_integer", "empty", "empty", "ok", "too_large", "too_large"
    ]
    assert values(spark, ["-10", "10", "-0", "x"], C.is_negative("x")) == [True, False, False, False]


@pytest.mark.parametrize(("value", "datatype", "status"), [
    ("12", "integer", "ok"), ("-12", "number", "ok"), ("--12", "number", "number"), ("1.5", "integer", "float"),
    ("1,5", "number", "float"), ("x", "integer", "integer"), ("TRUE", "bool", "ok"), ("0", "bool", "ok"),
    ("yes", "bool", "bool"), ("anything", "string", "ok"), ("", "integer", "ok"), (None, "integer", "ok"),
    ("x", "date", "date"), ("x", None, "ok"), ("-", "integer", "integer"),
])
def test_datatype_status(spark, value, datatype, status):
    df = spark.createDataFrame([(value, datatype)], "v string, d string")
    assert df.select(C.datatype_status("v", "d")).first()[0] == status


def test_local_seconds_follows_summer_time(spark):
    df = spark.sql("SELECT timestamp'2024-07-01 10:00:00.9' AS a, timestamp_ntz'2024-01-01 23:30:00.2' AS b")
    assert tuple(df.select(C.local_seconds("a"), C.local_seconds("b")).first()) == (
        "2024-07-01 12:00:00", "2024-01-02 00:30:00"
    )


def test_local_seconds_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT timestamp_seconds(1719828000) AS a, timestamp_ntz'2024-01-01 23:30:00.2' AS b")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tuple(df.select(C.local_seconds("a"), C.local_seconds("b")).first()) == (
            "2024-07-01 12:00:00", "2024-01-02 00:30:00"
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_change(spark):
    df = spark.createDataFrame([(3, 1), (None, 2), (2, None), (None, None), (1, 0)], "a int, b int")
    assert [tuple(r) for r in df.select(C.change("a", "b"), C.percent_change("a", "b")).collect()] == [
        (2, 200.0), (-2, -100.0), (2, None), (None, None), (1, None)
    ]
    assert df.select(C.percent_change("a", "b", missing_base=1)).collect()[2][0] == 200.0


def test_matches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "p int, f string")
    assert df.where(C.matches({"p": [1, 2], "f": "a"})).count() == 1
    assert df.where(C.matches({})).count() == 3


def test_calculated_field(spark):
    df = spark.createDataFrame(
        [("10", "4", "1"), ("10", "0", "1"), (None, "4", "1"), ("10", "4", None), (None, None, None), ("x", "4", "1")],
        "a string, b string, c string",
    )
    ratio = C.calculated_field(multiply=["a"], divide=["b"], add=["c"], decimals=1)
    assert [r[0] for r in df.select(ratio).collect()] == ["3.5", "0.0", "0.0", "2.5", "0.0", None]
    total = C.calculated_field(add=["a", "c", 5], subtract=["b"], decimals=2)
    assert [r[0] for r in df.select(total).collect()][:3] == ["12.00", "16.00", "2.00"]
    with pytest.raises(ValueError):
        C.calculated_field()


def test_calculated_field_rounds_the_exact_value(spark):
    df = spark.createDataFrame([(x,) for x in ("0.125", "2.675", "1165.495", "-0.5")], "a string")
    got = [r[0] for r in df.select(C.calculated_field(add=["a"], decimals=2)).collect()]
    assert got == [f"{x:.2f}" for x in (0.125, 2.675, 1165.495, -0.5)]


def test_calculated_field_stays_in_the_jvm(spark, plan):
    df = spark.createDataFrame([("1",)], "a string").select(C.calculated_field(add=["a"]), F.lit(1))
    assert "Python" not in plan(df)

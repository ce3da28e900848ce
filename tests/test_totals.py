import random

import pytest
from pyspark.sql import functions as F

from statedit.operators import aggregates as A
from statedit.operators import filters as FL
from statedit.operators import joins as J
from statedit.operators import statement as S
from statedit.operators.comments import activate_comment, add_comment, deactivate_comment
from statedit.scratch import small_table
from statedit.sources.survey_views import SurveyViews

OBS = "period int, form string, unit string, ref string, variable string, value string"


def survey(spark):
    obs = spark.createDataFrame([
        (2024, "A", "u1", "r1", "x", "10.9"), (2024, "A", "u2", "r2", "x", "20"), (2023, "A", "u1", "r0", "x", "8"),
        (2024, "A", "u1", "old", "x", "999"), (2024, "A", "u1", "r1", "t", "5"), (2024, "A", "u1", "r1", "y", "7"),
        (2023, "A", "u1", "r0", "z", "3"), (2024, "A", "u2", "r2", "y", "bad"),
    ], OBS)
    receipts = spark.sql("""
        SELECT period, unit, 'A' AS form, ref, true AS active, CAST(at AS timestamp_ntz) AS received_at
        FROM VALUES (2024, 'u1', 'r1', '2024-02-01'), (2024, 'u1', 'old', '2024-01-01'), (2024, 'u2', 'r2', '2024-01-01'),
                    (2023, 'u1', 'r0', '2023-01-01') AS t(period, unit, ref, at)""")
    types = small_table(spark, [("x", "int"), ("y", "number"), ("z", "float"), ("t", "string")], "variable string, datatype string")
    return obs, receipts, types


def test_period_totals(spark, rows):
    out = A.period_totals(*survey(spark), 2024)
    assert out.columns == ["variable", "2024", "2023", "diff", "pdiff"]
    assert rows(out) == [("x", 30, 8, 22, 275.0), ("y", 7, None, None, 700.0), ("z", None, 3, None, -100.0)]


def test_period_totals_with_a_zero_base(spark):
    obs, receipts, types = survey(spark)
    zero = obs.withColumn("value", F.when(F.col("period") == 2023, "0").otherwise(F.col("value")))
    assert [r.pdiff for r in A.period_totals(zero, receipts, types, 2024).where("variable = 'x'").collect()] == [None]


def test_plan_of_period_totals(spark, plan):
    text = plan(A.period_totals(*survey(spark), 2024))
    assert "partial_sum" in text and "Python" not in text and "CartesianProduct" not in text


def test_contributions(spark, rows):
    obs, *_ = survey(spark)
    assert rows(A.contributions(obs.where("ref <> 'old' and period = 2024"), "x")) == [("u1", 33.33), ("u2", 66.67)]
    assert A.contributions(obs, "x", k=1).count() == 1


def test_regions(spark, rows):
    obs, *_ = survey(spark)
    places = spark.createDataFrame([("u1", "0301")], "unit string, municipality string")
    assert rows(A.totals_by_region(obs.where("period = 2024"), places, "x"), "level", "county", "municipality", "total") == [
        ("all", None, None, 1029), ("county", None, None, 20), ("county", "03", None, 1009),
        ("municipality", None, None, 20), ("municipality", "03", "0301", 1009),
    ]
    assert A.units_in_region(obs, places, "x", "0301").count() == 3
    with pytest.raises(ValueError):
        J.region_values(places, places)


def test_receipt_monitoring(spark, rows):
    receipts = spark.sql("""
        SELECT unit, CAST(at AS timestamp) AS received_at FROM VALUES
          ('a', '2024-01-01 10:00:00'), ('a', '2024-01-02 10:00:00'), ('b', '2024-01-01 12:00:00'),
          ('c', '2024-01-02 10:00:00'), ('d', CAST(NULL AS STRING)) AS t(unit, at)""")
    units = spark.range(4)
    assert [(str(d), n) for d, n in rows(A.daily_receipts(receipts))] == [("2024-01-01", 2), ("2024-01-02", 2)]
    assert rows(A.cumulative_receipts(receipts, units), "n", "cumulative", "share") == [(1, 1, 25.0), (2, 3, 75.0)]


def test_section_totals(spark, rows):
    ledger = spark.createDataFrame([
        (1, "3000", 100), (1, "3300", 30), (1, "4000", 40), (1, "8300", 5), (1, "sumX", 999), (2, "8000", 7), (3, "sumX", 1), (4, "3000", None),
    ], "seq long, account string, amount int")
    out = A.section_totals(ledger, A.INCOME_SECTIONS, result_terms=A.RESULT_TERMS)
    lines = {(r.seq, r.kind, r.section): r.amount for r in out.collect()}
    assert {k[0] for k in lines} == {1, 2, 4}
    assert lines[1, "section", "salgsinntekter"] == 70
    assert lines[1, "section", "andre driftsinntekter"] is None
    assert lines[1, "heading", "driftsinntekter"] == 70
    assert lines[1, "heading", "finansposter og skattekostnad"] == 5
    assert lines[1, "result", "årsresultat"] == 70 - 40 - 5
    assert lines[2, "result", "årsresultat"] == 7 and lines[4, "result", "årsresultat"] is None
    balance = A.section_totals(ledger.withColumn("account", F.lit("1299")), A.BALANCE_SECTIONS)
    assert {r.section: r.amount for r in balance.where("seq = 1 and kind = 'section'").collect()}["anleggsmidler"] == -1174
    assert rows(J.assign_section(ledger, A.INCOME_SECTIONS).where("seq = 2"), "heading", "section") == [
        ("finansposter og skattekostnad", "finansinntekter")
    ]


def test_sections_of_dealt_lines(spark, rows, plan, tmp_path):
    """Lines are shuffled once, by submission, and no count holds a task's lines before."""
    lines = [(1, 0, 10.25), (1, 0, 1.0), (1, 189, 2.5), (2, 60, 4.0), (2, None, 8.0), (None, 60, 3.0), (None, 60, 3.0)]
    schema = "l_orderkey long, l_partkey long, l_extendedprice double"
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    ledger = SurveyViews(spark, str(tmp_path)).chart_ledger()
    assert rows(ledger.withColumn("amount", F.col("amount").cast("double"))) == [
        (None, "3220", 6.0), (1, "1000", 11.25), (1, "7993", 2.5), (2, None, 8.0), (2, "3220", 4.0)]
    out = A.section_totals(ledger, A.INCOME_SECTIONS, result_terms=A.RESULT_TERMS)
    text = plan(out)
    assert text.count("Exchange hashpartitioning(seq") == 1 and "REPARTITION_BY_NUM" in text and text.count("Exchange") == 1
    assert "HashAggregate" not in text[text.index("REPARTITION_BY_NUM"):]
    result = {r.seq: r.amount for r in out.where("kind = 'result'").collect()}
    assert {k: float(x) for k, x in result.items()} == {None: 6.0, 1: -2.5, 2: 4.0}


def test_distribution(spark):
    rng = random.Random(4)
    data = [(2024, "A", f"u{i}", f"r{i}", "x", str(rng.randint(0, 100))) for i in range(60)] + [(2024, "A", "big", "rb", "x", "1000")]
    obs = spark.createDataFrame(data + [(2024, "A", "n", "rn", "x", None)], OBS)
    box = A.distribution(obs, "x").first()
    assert (box.n, box.maximum) == (61, 1000.0) and box.minimum <= box.q1 <= box.median <= box.q3 < box.upper
    assert [r.ref for r in A.distribution_points(obs, "x").where("outlier").collect()] == ["rb"]


def test_histogram(spark, rows):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 4, 5, 10, 10)] + [(None,)], "x double")
    assert rows(A.histogram(df, "x", 2)) == [(0, 0.0, 5.0, 3), (1, 5.0, 10.0, 3)]
    assert rows(A.histogram(df.where("x = 10"), "x", 3), "bin", "n") == [(0, 2)]


def test_small_operators(spark, rows):
    obs, receipts, types = survey(spark)
    assert rows(A.variables_side_by_side(obs.where("ref <> 'old'"), ["x", "y"], "r1")) == [
        ("u1", 9.0, 7.0, True), ("u2", 20.0, None, False)
    ]
    assert [r.ref for r in A.pin_first(receipts, "ref", "r1", "ref").collect()] == ["r1", "old", "r0", "r2"]
    frame = spark.createDataFrame([("A, B",), ("B",), (None,)], "form string")
    assert rows(A.forms_in_frame(frame)) == [("A",), ("B",)]
    assert rows(A.wide_statement(spark.sql("SELECT 1L AS seq, 'a' AS account, 2 AS amount"), ["a", "b"])) == [(1, 2, None)]
    assert FL.select_matching(receipts, ["unit"], "ref|status").columns == ["unit", "ref"]
    assert rows(FL.unpivot(spark.sql("SELECT 1 AS id, 5 AS a, 0 AS b, CAST(NULL AS INT) AS c"), ["id"], ["a", "b", "c"], True)) == [(1, "a", "5.0")]
    aligned = FL.align_columns(receipts, {"unit": "ident"}, ["ident", "extra"], default="")
    assert aligned.columns == ["ident", "extra"] and {r.extra for r in aligned.collect()} == {""}
    assert FL.drop_if_present(receipts.withColumn("ref_right", F.lit(1)), ["nope"]).columns == receipts.columns
    checks = {"y": F.when(F.col("variable") == "y", "bad").otherwise("ok")}
    assert FL.failing_rows(obs, checks).count() == 2
    names = spark.createDataFrame([(2024, "A", "x", "/a/x")], "period int, form string, variable string, path string")
    assert rows(J.resolve_name(obs, names).where("ref in ('r0', 'r2')"), "ref", "name") == [
        ("r0", "x"), ("r0", "z"), ("r2", "/a/x"), ("r2", "y")
    ]
    change = J.year_change(obs, receipts, 2024)
    assert rows(change.where("variable = 'x'"), "unit", "value", "previous_value", "diff") == [
        ("u1", "10.9", "8", pytest.approx(2.9)), ("u2", "20", None, 20.0)
    ]


def book(spark):
    ledger = spark.createDataFrame([
        (1, "3000", 100), (1, "3001", 5), (1, "sumDriftsinntekt", 100), (2, "3000", 80), (3, "3000", 1),
    ], "seq long, account string, amount int")
    catalogue = small_table(spark, [
        (0, "", "Driftsinntekter"), (1, "3000", "Sales"), (2, "3001", "Oil"), (3, "3300", "Tax"), (4, "sumDriftsinntekt", "Total"),
    ], "line_no int, account string, text string")
    submissions = spark.createDataFrame([(1, 2, "u1"), (3, None, "u2")], "seq long, compare_seq long, unit string")
    return ledger, catalogue, submissions


def test_statement(spark, rows):
    comments = spark.sql("""SELECT 1L AS id, 'u1' AS unit, 'variable' AS level, '3000' AS variable, 'check' AS comment, true AS active,
                                   timestamp_ntz'2024-01-01 00:00:00' AS created_at""")
    out = S.statement(*book(spark), comments)
    assert out.count() == 10
    assert rows(out.where("account = '3000'"), "seq", "value", "compare_value", "diff", "comment") == [
        (1, 100, 80, 20, "check"), (3, 1, None, None, None)
    ]
    assert rows(out.where("account = '3001' and seq = 1"), "value", "compare_value", "diff") == [(5, None, 5)]


def test_statement_with_sections(spark):
    ledger, catalogue, submissions = book(spark)
    out = S.statement_with_sections(ledger, catalogue, submissions, A.INCOME_SECTIONS, A.RESULT_TERMS)
    shown = [(r.account, r.description, r.value) for r in out.where("seq = 1").collect()]
    assert shown == [
        ("", "Driftsinntekter", None), ("3000", "Sales", 100), ("", "SUM forslag for salgsinntekter", 105),
        ("", "Total", 100), ("", "SUM forslag for driftsinntekter", 105),
    ]
    sector = spark.createDataFrame([("u1",)], "unit string")
    oil = S.statement_with_sections(ledger, catalogue, submissions, A.INCOME_SECTIONS, sector_units=sector)
    assert [r.seq for r in oil.where("account = '3001'").collect()] == [1]
    blank = S.statement_with_sections(ledger, catalogue, submissions, A.INCOME_SECTIONS, show_blank=True, show_special=True)
    assert blank.where("seq = 3 and kind = 'account'").count() == 5


def test_a_long_catalogue(spark):
    ledger, _, submissions = book(spark)
    long = spark.range(20_000).selectExpr("int(id) AS line_no", "string(id) AS account", "concat('line ', id) AS text")
    out = S.statement(ledger, long, submissions)
    assert out.count() == 40_000 and out.select("seq", "line_no").distinct().count() == 40_000
    assert [(r.seq, r.value, r.compare_value) for r in out.where("account = '3000'").orderBy("seq").collect()] == [
        (1, 100, 80), (3, 1, None)
    ]


def test_amounts_keep_their_decimals(spark):
    ledger = spark.sql("""
        SELECT 1L AS seq, account, CAST(amount AS decimal(24,4)) AS amount
        FROM VALUES ('3000', '0.0049'), ('3000', '0.0049'), ('3001', '90000000000000000.0001') AS t(account, amount)""")
    out = A.section_totals(ledger, A.INCOME_SECTIONS).where("kind = 'section' and section = 'salgsinntekter'")
    assert str(out.first().amount) == "90000000000000000.0099"
    assert str(A.wide_statement(ledger, ["3000"]).first()["3000"]) == "0.0098"


COMMENTS = "id long, unit string, level string, variable string, comment string, active boolean"


def test_comments(spark, rows):
    stored = spark.createDataFrame([
        (1, "u", "general", None, "a", True), (2, "u", "variable", "3000", "b", True), (3, "u", "variable", "3000", "c", False),
        (4, "v", "general", None, "d", True),
    ], COMMENTS)
    new = spark.createDataFrame([(5, "u", "general", None, "it's"), (6, "w", "general", None, None)], "id long, unit string, level string, variable string, comment string")
    assert rows(add_comment(stored, new), "id", "comment", "active") == [
        (1, "a", False), (2, "b", True), (3, "c", False), (4, "d", True), (5, "it's", True), (6, "", True)
    ]
    pick = spark.createDataFrame([(3,)], "id long")
    assert rows(activate_comment(stored, pick).where("active"), "id") == [(1,), (3,), (4,)]
    assert rows(deactivate_comment(stored, spark.createDataFrame([(4,)], "id long")).where("active"), "id") == [(1,), (2,)]

"""Interval joins, chosen partitions, free SQL of its own, references in one pass, and what must fail."""

import random

import pytest
from pyspark.sql import functions as F

from statedit.functions import columns as X
from statedit.operators import comments as CM
from statedit.operators import joins as J
from statedit.operators import quality as Q
from statedit.plans.adhoc import free_search
from statedit.sources import tables as S

SECTIONS = "heading string, section string, start long, end long"


def test_sections_as_a_table(spark, rows):
    rng = random.Random(1)
    at, sections = 0, []
    for i in range(10_000):
        start = at + rng.choice([0, 0, 1, 30])
        at = start + rng.choice([1, 1, 3, 500])
        sections.append((f"h{i % 7}", f"s{i}", start, at - 1))
    sections.append(("wide", "last", at, at + 3_000_000))
    accounts = [rng.randrange(-5, at + 100) for _ in range(3000)] + [at + 2_999_999, at + 3_000_001]
    ledger = spark.createDataFrame([(str(a), a) for a in accounts] + [("x", -1), (None, -2)], "account string, heading long")
    want = []
    for a in accounts:
        want += [(str(a), h, s) for h, s, lo, hi in sections if lo <= a <= hi]
    table = spark.createDataFrame(sections + [("none", "none", None, 5)], SECTIONS)
    assert rows(J.assign_section_by_table(ledger, table), "account", "heading", "section") == sorted(want)
    assert J.assign_section_by_table(ledger, table.limit(0)).count() == 0


@pytest.mark.parametrize("bad", [[("h", "a", 1, 5), ("h", "b", 5, 9)], [("h", "a", 1, 100), ("h", "b", 2, 3), ("h", "c", 50, 60)], [("h", "a", 4, 3)]])
def test_sections_that_overlap(spark, bad):
    with pytest.raises(ValueError, match="overlap"):
        J.assign_section_by_table(spark.createDataFrame([("1",)], "account string"), spark.createDataFrame(bad, SECTIONS))


def test_chosen_partitions_open_no_other_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.createDataFrame([(y, f, i) for y in (2021, 2022, None) for f in ("A", "B") for i in range(3)], "year int, form string, v int").write.partitionBy(
        "year", "form").parquet(path)
    for file in (tmp_path / "t" / "year=2021" / "form=B").glob("*.parquet"):
        file.write_bytes(b"no parquet")
        (file.parent / f".{file.name}.crc").unlink()
    schema = spark.read.parquet(str(tmp_path / "t" / "year=2022" / "form=A")).schema.add("year", "integer").add("form", "string")
    wanted = spark.createDataFrame([(2021, "A", 5), (2022, "B", 6), (None, "A", 9), (2021, "A", 7)], "year int, form string, x int").where("x > 0").select("year", "form")
    got = S.scan_chosen(spark, path, wanted, schema)
    assert got.count() == 9 and S.scan_chosen(spark, path, wanted.limit(0), schema).count() == 0
    with pytest.raises(Exception):
        S.scan_table(spark, path, schema=schema).count()
    monkeypatch.setattr(S, "MOST_NAMED", 1)
    again = S.scan_chosen(spark, path, wanted.where("form = 'A'"), schema)
    assert again.where("year is null").count() == 3


def test_free_sql_leaves_the_session_alone(spark, rows):
    mine = spark.createDataFrame([(1,)], "period int")
    mine.createOrReplaceTempView("forms")
    df = spark.createDataFrame([(2023, 1), (2024, 2), (2024, 3)], "period int, row_id int")
    before = {t.name for t in spark.catalog.listTables()}
    found = free_search(spark, "/* all */ WITH x AS (SELECT * FROM forms WHERE row_id > :least) SELECT period FROM x ORDER BY row_id DESC;", {"forms": df},
                        {"period": [2024]}, {"least": 2})
    assert rows(found) == [(2024,)]
    assert free_search(spark, "SELECT count(*) AS n FROM forms", {"forms": df}).first().n == 3
    assert {t.name for t in spark.catalog.listTables()} == before and rows(spark.table("forms")) == [(1,)]
    for bad in ("DROP VIEW forms", "CREATE TABLE a AS SELECT 1", "INSERT INTO forms SELECT 1", "WITH x AS (SELECT 1) INSERT INTO forms SELECT * FROM x",
                "FROM forms INSERT INTO a SELECT * INSERT INTO b SELECT *", "SET x = 1", "CACHE TABLE forms"):
        with pytest.raises(ValueError, match="Only queries"):
            free_search(spark, bad, {"forms": df})
    assert rows(spark.table("forms")) == [(1,)]
    spark.catalog.dropTempView("forms")


def test_references_in_one_pass(spark, rows, plan):
    units = spark.createDataFrame([(1, "u"), (1, "v")], "period long, unit string")
    receipts = spark.createDataFrame([(1, "A", "u", "r"), (1, "A", "x", "s"), (1, "A", None, "t"), (2, "A", "u", "q")], "period int, form string, unit string, ref string")
    contacts = spark.createDataFrame([(1, "A", "u", "r"), (1, "A", "w", "r"), (1, "A", "u", "r"), (1, "A", "w", "r")], "period int, form string, unit string, ref string")
    report = Q.reference_report({"units": units, "receipts": receipts, "contacts": contacts})
    assert rows(report) == [("contacts", "receipts", 2), ("contacts", "units", 2), ("receipts", "units", 2)]
    assert Q.orphans(receipts, units, ["period", "unit"]).count() == 2
    assert plan(report).count("ExistingRDD") <= 5
    with pytest.raises(ValueError):
        Q.reference_report({"units": units})


def test_keys_are_counted_behind_the_shuffle(spark, rows, plan):
    """No count holds the keys of a task's rows before they are dealt."""
    units = spark.createDataFrame([(1, "u"), (1, None)], "period long, unit string")
    receipts = spark.createDataFrame([(1, "x"), (1, "x"), (1, "u"), (None, "u")], "period int, unit string")
    report = Q.reference_report({"units": units, "receipts": receipts})
    assert rows(report) == [("receipts", "units", 2)]
    text = plan(report)
    assert "Exchange hashpartitioning(i" in text and "HashAggregate" not in text[text.index("REPARTITION_BY_NUM"):]


def test_numbers_beyond_the_type(spark, rows):
    df = spark.createDataFrame([(v,) for v in ("12.9", "9223372036854775807", "NaN", "Infinity", "x", None, "1e3")], "v string")
    assert rows(df.select(X.coerce_numeric("v").alias("n"))) == [(None,)] * 4 + [(12,), (1000,), (9223372036854775807,)]
    for big in ("9223372036854775808", "99999999999999999999", "1e30"):
        with pytest.raises(Exception, match="beyond"):
            spark.createDataFrame([(big,)], "v string").select(X.coerce_numeric("v", 0)).collect()
    amounts = spark.createDataFrame([("NaN",), ("1.5",), ("-Infinity",)], "amount string")
    assert [str(r[0]) for r in amounts.select(X.exact_amount(amounts)).collect()] == ["None", "1.500000", "None"]
    doubles = spark.createDataFrame([(float("nan"),), (0.25,)], "amount double")
    assert [str(r[0]) for r in doubles.select(X.exact_amount(doubles)).collect()] == ["None", "0.250000"]


def test_two_comments_of_one_key_fail(spark):
    schema = "id long, unit string, level string, variable string, comment string, active boolean"
    stored = spark.createDataFrame([(1, "u", "general", None, "a", True), (2, "u", "general", None, "b", False)], schema)
    new = spark.createDataFrame([(5, "u", "general", None, "x"), (6, "u", "general", None, "y")], "id long, unit string, level string, variable string, comment string")
    with pytest.raises(Exception, match="Two new comments"):
        CM.add_comment(stored, new).collect()
    with pytest.raises(Exception, match="cannot both be active"):
        CM.activate_comment(stored, spark.createDataFrame([(1,), (2,)], "id long")).collect()
    assert CM.activate_comment(stored, spark.createDataFrame([(2,), (2,)], "id long")).where("active").select("id").collect()[0].id == 2

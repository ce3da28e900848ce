import pytest
from pyspark.sql import functions as F

from statedit.operators import controls as C
from statedit.operators.aggregates import control_overview, hit_counts, rank_hits, top_hits
from statedit.operators.joins import diff_rows, expand_scope, link_periods, new_units
from statedit.plans.control_run import run_control_suite

META = {"id": "001", "kind": "H", "description": "d", "variables": ["x"]}


def test_metadata():
    @C.control(**META, sort_by="x", order="ASC", owner="me")
    def check(ctx):
        return None

    assert check.control_meta == {
        "control_id": "001", "kind": "H", "description": "d", "variables": ["x"], "sort_by": "x", "sort_order": "ASC", "owner": "me"
    }
    assert C.control(**META)(lambda ctx: None).control_meta["sort_order"] == "DESC"
    assert C.control(**META)(lambda ctx: None).control_meta["sort_by"] == ""


@pytest.mark.parametrize(("change", "error"), [
    ({"variables": "x"}, TypeError), ({"kind": "X"}, ValueError), ({"order": "INVALID"}, ValueError),
])
def test_metadata_errors(change, error):
    with pytest.raises(error):
        C.control(**{**META, **change})


def test_find_controls():
    assert [c.control_meta["control_id"] for c in C.find_controls(C)] == ["duplicate_submission", "large_change", "new_unit"]
    with pytest.raises(ValueError):
        C.find_controls(object())


RESULT = "period int, form string, unit string, ref string, hit boolean, value int"
SCOPE = {"period": 2024, "form": "A"}


def result(spark, data=((2024, "A", "u1", "r1", True, 5), (2024, "A", "u2", "r2", False, 0))):
    return spark.createDataFrame(list(data), RESULT)


@pytest.fixture(scope="module")
def meta():
    return C.control(**META)(lambda ctx: None).control_meta


def test_valid_result(spark, meta):
    out = C.validate_result(result(spark), meta, SCOPE)
    assert {r.control_id for r in out.collect()} == {"001"}
    C.validate_result(result(spark).drop("value"), meta, {"period": [2024], "form": ["A"]})


@pytest.mark.parametrize(("break_it", "message"), [
    (lambda df: df.drop("hit"), "Missing required"),
    (lambda df: df.withColumn("note", F.lit(1)), "extra columns"),
    (lambda df: df.withColumn("period", F.when(F.col("ref") == "r1", 2023).otherwise(2024)), "more than one value"),
    (lambda df: df.withColumn("period", F.lit(2023)), "expected '2024'"),
    (lambda df: df.withColumn("form", F.when(F.col("ref") == "r1", "A")), "more than one value"),
    (lambda df: df.withColumn("control_id", F.lit("002")), "expected '001'"),
    (lambda df: df.withColumn("control_id", F.col("ref")), "more than one value"),
    (lambda df: df.unionByName(df), "duplicate rows"),
    (lambda df: df.drop("form"), "Scope columns"),
    (lambda df: df.where("false"), "no rows"),
])
def test_invalid_results_raise(spark, meta, break_it, message):
    with pytest.raises(ValueError, match=message):
        C.validate_result(break_it(result(spark)), meta, SCOPE)


def test_result_must_be_a_table(meta):
    with pytest.raises(TypeError):
        C.validate_result([1], meta, SCOPE)


HITS = "period int, form string, unit string, ref string, control_id string, hit boolean, value int"


def test_sync(spark, rows):
    existing = spark.createDataFrame([
        (2024, "A", "u1", "r1", "c", True, 5), (2024, "A", "u2", "r2", "c", True, 1), (2024, "A", "u3", "r3", "c", True, 1),
        (2024, "A", "u4", "r4", "c", True, None),
    ], HITS)
    new = spark.createDataFrame([
        (2024, "A", "u1", "r1", "c", True, 5), (2024, "A", "u2", "r2", "c", False, 9), (2024, "A", "u5", "r5", "c", True, None),
        (2024, "A", "u4", "r4", "c", True, None),
    ], HITS)
    synced = C.sync_hits(existing, new, ["period", "form"])
    assert rows(synced, "ref", "hit", "value", "outcome") == [
        ("r1", True, 5, "keep"), ("r2", False, 9, "update"), ("r3", True, 1, "untouched"), ("r4", True, None, "keep"),
        ("r5", True, None, "insert"),
    ]
    again = C.sync_hits(synced.drop("outcome"), new, ["period", "form"])
    assert {r.outcome for r in again.collect()} == {"keep", "untouched"}
    without = C.sync_hits(existing, new.drop("value"), ["period", "form"])
    assert rows(without.where("ref = 'r2'"), "hit", "value", "outcome") == [(False, 1, "update")]


def tables(spark):
    receipts = spark.sql("""
        SELECT period, unit, form, ref, active, 'Ubehandlet' AS status,
               CAST(concat(period, '-02-0', substr(ref, 2, 1)) AS timestamp_ntz) AS received_at
        FROM VALUES (2024, 'u1', 'A', 'r1', true), (2024, 'u1', 'A', 'r2', true), (2024, 'u2', 'A', 'r3', true),
                    (2023, 'u1', 'A', 'r4', true), (2023, 'u3', 'A', 'r5', true), (2024, 'u3', 'B', 'r6', true),
                    (2024, 'u3', 'A', 'r7', false) AS t(period, unit, form, ref, active)""")
    observations = spark.sql("""
        SELECT period, form, unit, ref, 'x' AS variable, value
        FROM VALUES (2024, 'A', 'u1', 'r1', '9999'), (2024, 'A', 'u1', 'r2', '350'), (2023, 'A', 'u1', 'r4', '100'),
                    (2024, 'A', 'u2', 'r3', '5'), (2023, 'A', 'u3', 'r5', '0'), (2024, 'A', 'u3', 'r7', '8')
        AS t(period, form, unit, ref, value)""")
    return {"receipts": receipts, "observations": observations}


def test_built_in_controls(spark, rows):
    ctx = C.ControlContext(tables(spark), SCOPE, options={"variable": "x"})
    assert rows(C.large_change(ctx), "ref", "hit", "value") == [("r2", True, 250)]
    assert rows(C.new_unit(ctx), "ref", "hit") == [("r1", False), ("r2", False), ("r3", True), ("r7", False)]
    assert rows(C.duplicate_submission(ctx), "ref", "hit") == [("r1", True), ("r2", True), ("r3", False), ("r7", False)]


def test_run_suite(spark, rows):
    ctx = C.ControlContext(tables(spark), SCOPE, options={"variable": "x"})
    hits = spark.createDataFrame([], HITS)
    names = "period int, form string, control_id string, kind string, description string, sort_by string, sort_order string"
    catalogue = spark.createDataFrame([], names)
    run = run_control_suite(C.find_controls(C), ctx, catalogue, hits)
    overview = run.overview(tables(spark)["receipts"])
    assert rows(overview, "control_id", "n_hits", "n_untreated") == [
        ("duplicate_submission", 2, 2), ("large_change", 1, 1), ("new_unit", 1, 1)
    ]
    assert rows(hit_counts(run.hits).where("control_id = 'new_unit'"), "hit", "n") == [(False, 3), (True, 1)]
    second = run_control_suite(C.find_controls(C), ctx, run.catalogue, run.hits.drop("outcome"))
    assert second.catalogue.count() == 3 and {r.outcome for r in second.hits.collect()} == {"keep"}


def test_a_control_that_forgets_the_scope_fails(spark):
    @C.control("all_years", "S", "d", ["x"])
    def all_years(ctx):
        return ctx.table("receipts").select("period", "form", "unit", "ref", F.lit(True).alias("hit"))

    with pytest.raises(ValueError, match="all_years"):
        C.run_controls([C.new_unit, all_years], C.ControlContext(tables(spark), SCOPE))


def test_catalogue(spark, rows):
    cat = C.catalogue(spark, C.find_controls(C), {"period": [2023, 2024], "form": "A"})
    assert cat.count() == 6 and "variables" not in cat.columns
    some = cat.where("control_id = 'new_unit' and period = 2023")
    assert C.register_controls(some, C.find_controls(C), {"period": [2023, 2024], "form": "A"}).count() == 6
    assert rows(expand_scope(spark.range(1), {"a": [1, 2], "b": "x"})) == [(0, 1, "x"), (0, 2, "x")]


def test_overview_keeps_controls_without_hits(spark, rows):
    controls = spark.createDataFrame([("c",), ("d",)], "control_id string")
    hits = spark.createDataFrame([(2024, "A", "u1", "r1", "c", True, 1), (2024, "A", "u2", "r2", "c", True, 1)], HITS)
    receipts = spark.createDataFrame([("u1", "r1", True, False), ("u2", "r2", True, True)], "unit string, ref string, active boolean, edited boolean")
    assert rows(control_overview(controls, hits, receipts)) == [("c", 2, 1), ("d", 0, 0)]


def test_sorting_follows_the_control(spark, rows):
    hits = spark.createDataFrame([(2024, "A", f"u{i}", f"r{i}", c, True, v) for i, (c, v) in enumerate(
        [("up", 3), ("up", 9), ("down", -5), ("down", 2), ("down", -5)])], HITS)
    controls = spark.createDataFrame([("up", "DESC"), ("down", "ASC")], "control_id string, sort_order string")
    assert rows(rank_hits(hits, controls), "control_id", "value", "rank") == [
        ("down", -5, 1), ("down", -5, 1), ("down", 2, 3), ("up", 3, 2), ("up", 9, 1)
    ]
    assert rows(top_hits(hits, controls, 1), "control_id", "ref") == [("down", "r2"), ("up", "r1")]


def test_periods_and_differences(spark, rows):
    receipts = tables(spark)["receipts"]
    assert rows(link_periods(receipts, {"period": 2024}, {"period": 2023})) == [
        ("u1", "r2", "r4"), ("u2", "r3", None), ("u3", "r6", "r5")
    ]
    assert rows(new_units(receipts, 2024).where("hit"), "ref") == [("r3",)]
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, j string")
    b = spark.createDataFrame([(1, None), (3, "x")], "k int, j string")
    assert rows(diff_rows(a, b, ["k", "j"])) == [(1, None, "both"), (2, "x", "new_only"), (3, "x", "old_only")]

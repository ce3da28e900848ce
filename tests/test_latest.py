from pyspark.sql import functions as F

from statedit.operators import latest as L

RECEIPTS = "period int, unit string, form string, ref string, received_at timestamp_ntz, active boolean"


def receipts(spark):
    return spark.sql("""
        SELECT * FROM VALUES
          (2024, 'u1', 'A', 'r1', timestamp_ntz'2024-01-01 10:00:00', true),
          (2024, 'u1', 'A', 'r2', timestamp_ntz'2024-01-02 10:00:00', true),
          (2024, 'u1', 'A', 'r3', timestamp_ntz'2024-01-03 10:00:00', false),
          (2023, 'u1', 'A', 'r0', timestamp_ntz'2023-01-03 10:00:00', true),
          (2024, 'u2', 'B', 'r4', timestamp_ntz'2024-01-01 10:00:00', true),
          (2024, 'u2', 'B', 'r5', timestamp_ntz'2024-01-01 10:00:00', true),
          (2024, 'u3', 'B', 'r6', CAST(NULL AS timestamp_ntz), true),
          (2023, 'u4', 'B', 'r7', timestamp_ntz'2023-05-01 10:00:00', true)
        AS t(period, unit, form, ref, received_at, active)""")


def test_latest_active(spark, rows):
    assert rows(L.latest_active(receipts(spark)), "unit", "ref") == [
        ("u1", "r2"), ("u2", "r5"), ("u3", "r6"), ("u4", "r7")
    ]
    assert rows(L.latest_active(receipts(spark), form="A"), "ref") == [("r2",)]
    assert L.latest_active(receipts(spark), form="all").count() == 4
    assert rows(L.latest_active(receipts(spark), filters={"period": 2023}), "ref") == [("r0",), ("r7",)]
    assert rows(L.latest_active_per_period(receipts(spark)), "ref") == [("r0",), ("r2",), ("r5",), ("r6",), ("r7",)]


def test_latest_reduces_before_the_shuffle(spark, plan):
    """A unit with very many responses must not be sorted whole in one task."""
    text = plan(L.latest_active(receipts(spark).repartition(4)))
    assert "WindowGroupLimit" in text and "Partial" in text
    exchange = text.index("Exchange hashpartitioning(unit")
    assert text.index("Partial", exchange) > exchange


def test_versions(spark, rows):
    versions = spark.sql("""
        SELECT * FROM VALUES ('u1', 2024, 1L, 1, timestamp_ntz'2024-01-01 00:00:00'),
                             ('u1', 2024, 2L, 2, timestamp_ntz'2024-02-01 00:00:00'),
                             ('u1', 2023, 3L, 1, timestamp_ntz'2023-02-01 00:00:00'),
                             ('u1', 2023, 4L, 2, timestamp_ntz'2023-02-01 00:00:00')
        AS t(unit, period, seq, version_no, received_at)""")
    counts = spark.sql("SELECT 1L AS seq, 3L AS n_changes")
    active = L.active_version(versions, counts)
    assert rows(active, "period", "seq") == [(2023, 4), (2024, 1)]
    labels = L.comparable_versions(L.with_update_counts(versions, counts), 2024)
    assert rows(labels, "seq", "label") == [
        (1, "v1 – 2024-01-01 00:00 (editert)"), (2, "v2 – 2024-02-01 00:00"), (4, "2023")
    ]
    assert rows(L.is_latest_version(versions).where("is_latest"), "seq") == [(2,), (4,)]


def test_duplicate_submissions(spark, rows):
    out = L.duplicate_submissions(receipts(spark), {"period": 2024})
    assert rows(out.where("hit"), "ref") == [("r1",), ("r2",), ("r3",), ("r4",), ("r5",)]
    assert out.count() == 6


def test_hot_unit_is_split_by_adaptive_execution(spark):
    """One unit with most rows: the join back is marked as skewed and split."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        data = spark.range(0, 60000, 1, 8).select(
            F.lit(2024).alias("period"),
            F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("hot").alias("unit"),
            F.sha2(F.col("id").cast("string"), 256).alias("ref"),
        )
        out = L.duplicate_submissions(data)
        assert out.where("hit").count() == 20000
        assert out.collect() and "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_comments(spark, rows):
    comments = spark.sql("""
        SELECT * FROM VALUES (1L, 'u', 'variable', '3000', 'old', true, timestamp_ntz'2024-01-01 00:00:00'),
            (2L, 'u', 'variable', '3000', 'new', true, timestamp_ntz'2024-01-02 00:00:00'),
            (3L, 'u', 'variable', '3000', 'off', false, timestamp_ntz'2024-01-03 00:00:00'),
            (4L, 'u', 'general', CAST(NULL AS STRING), 'all', true, timestamp_ntz'2024-01-01 00:00:00')
        AS t(id, unit, level, variable, comment, active, created_at)""")
    assert rows(L.latest_comment(comments, "variable"), "comment") == [("new",)]
    assert rows(L.latest_comment(comments, "general"), "comment") == [("all",)]

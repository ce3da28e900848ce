import datetime

import pytest

from statedit.operators.aggregates import daily_receipts
from statedit.sources.versioned import Store
from statedit.streaming import receipts
from statedit.streaming.receipts import (
    current_daily_receipts, current_latest_active, current_responses, latest_active_writer, read_daily_receipts,
    start_daily_receipts, stream_daily_receipts, stream_latest_active,
)

SCHEMA = "unit string, ref string, active boolean, received_at timestamp"


def batch(spark, *data, ahead=0):
    zone = datetime.timezone(datetime.timedelta(hours=ahead))
    return spark.createDataFrame(
        [(u, r, a, datetime.datetime(2024, 1, d, h, tzinfo=zone)) for u, r, a, d, h in data], SCHEMA
    )


def test_latest_active_over_batches(spark, tmp_path, rows):
    target = str(tmp_path / "latest")
    assert current_latest_active(spark, target) is None
    write = latest_active_writer(target, compact_every=3)
    write(batch(spark, ("u1", "r1", True, 1, 0), ("u2", "r2", True, 1, 0)), 0)
    write(batch(spark, ("u1", "r3", True, 2, 0)), 1)
    assert rows(current_latest_active(spark, target), "ref") == [("r2",), ("r3",)]
    # The newest response is switched off: the earlier one counts again.
    write(batch(spark, ("u1", "r3", False, 2, 0)), 2)
    assert rows(current_latest_active(spark, target), "ref") == [("r1",), ("r2",)]
    for _ in range(2):  # a batch that is repeated after a failure, across a merge
        write(batch(spark, ("u3", "r4", True, 3, 0)), 3)
    assert rows(current_latest_active(spark, target), "ref") == [("r1",), ("r2",), ("r4",)]
    for i in range(4, 8):
        write(batch(spark, ("u4", f"s{i}", True, i, 0)), i)
    assert rows(current_latest_active(spark, target), "ref") == [("r1",), ("r2",), ("r4",), ("s7",)]
    held = Store(spark, target).manifest().tables["receipts"].parts
    assert all(len(folders) < 5 for folders in held.values())


def test_default_writers_never_overwrite(spark, tmp_path, rows):
    """Two writers without a checkpoint both begin at batch 0."""
    target = str(tmp_path / "latest")
    latest_active_writer(target)(batch(spark, ("u0", "old0", True, 1, 0)), 0)
    latest_active_writer(target)(batch(spark, ("u1", "old1", True, 1, 0)), 1)
    latest_active_writer(target)(batch(spark, ("u2", "new0", True, 1, 0)), 0)
    assert rows(current_latest_active(spark, target), "ref") == [("new0",), ("old0",), ("old1",)]


def test_merges_touch_only_full_buckets(spark, tmp_path, rows):
    target = str(tmp_path / "latest")
    write = latest_active_writer(target, compact_every=3, buckets=4)
    write(batch(spark, *[(f"w{i}", f"x{i}", True, 1, 0) for i in range(40)]), 0)
    start = Store(spark, target).manifest().tables["receipts"].parts
    assert len(start) == 4
    for i in range(1, 10):
        write(batch(spark, ("u1", "r", i % 2 == 0, 1 + i, 0)), i)
    after = Store(spark, target).manifest().tables["receipts"].parts
    changed = [p for p in start if start[p] != after[p]]
    assert len(changed) == 1 and {f.split("/")[0][-3:] for f in after[changed[0]]} <= {"-L0", "-L1", "-L2"}
    assert any("-L2" in f for f in after[changed[0]])
    assert current_latest_active(spark, target).count() == 40
    assert rows(current_responses(spark, target, ["u1", "w3", "nobody"]), "ref", "active") == [("r", False), ("x3", True)]
    assert len(current_responses(spark, target, ["u1"]).inputFiles()) < len(current_responses(spark, target).inputFiles())


def test_counts_of_all_days(spark, tmp_path, rows):
    """Late responses and open days are counted, over restarts, and a repeated batch changes nothing."""
    source, target, state = (str(tmp_path / n) for n in ("in", "days", "state"))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        start_daily_receipts(stream, target, state, availableNow=True).awaitTermination()
        return [(str(d), n) for d, n in rows(read_daily_receipts(spark, target))]

    assert read_daily_receipts(spark, target) is None
    batch(spark, ("u1", "a", True, 9, 5), ("u2", "b", True, 3, 23)).coalesce(1).write.parquet(source)
    assert run() == [("2024-01-03", 1), ("2024-01-09", 1)]
    batch(spark, ("u3", "c", True, 1, 22), ("u4", "d", True, 3, 12)).coalesce(1).write.mode("append").parquet(source)
    want = [("2024-01-01", 1), ("2024-01-03", 2), ("2024-01-09", 1)]
    assert run() == want and run() == want
    assert want == [(str(d), n) for d, n in rows(daily_receipts(spark.read.schema(SCHEMA).parquet(source)))]
    again = spark.createDataFrame([(datetime.date(2024, 1, 3), 2)], "day date, n long")
    receipts._daily_writer(target, state)(again, 1)
    assert [(str(d), n) for d, n in rows(read_daily_receipts(spark, target))] == want


def test_a_fresh_checkpoint_keeps_what_is_stored(spark, tmp_path, rows):
    target = str(tmp_path / "latest")
    for run in range(2):
        source = str(tmp_path / f"in{run}")
        for i in range(5):
            one = batch(spark, (f"u{run}{i}", f"r{run}{i}", True, 1 + i, 0)).coalesce(1)
            one.write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream_latest_active(stream, target, str(tmp_path / f"state{run}"), 3, availableNow=True).awaitTermination()
        expected = sorted((f"r{r}{i}",) for r in range(run + 1) for i in range(5))
        assert rows(current_latest_active(spark, target), "ref") == expected
    days = [(str(d), n) for d, n in rows(current_daily_receipts(spark, target))]
    assert days == [(f"2024-01-0{1 + i}", 2) for i in range(5)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_daily_counts_close_with_the_watermark(spark, tmp_path, zone):
    """Days are calendar days of the session's clock; the data lies 9 hours later in Tokyo."""
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        check_daily_counts(spark, tmp_path, 0 if zone == "UTC" else 9)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def check_daily_counts(spark, tmp_path, ahead):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = (
            stream_daily_receipts(stream, "1 hour").writeStream.outputMode("append").format("parquet")
            .option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        days = spark.read.schema("day date, n long").parquet(out) if (tmp_path / "out").exists() else None
        return sorted((str(r.day), r.n) for r in days.collect())

    batch(spark, ("u1", "a", True, 1, 5), ("u2", "b", True, 1, 23), ahead=ahead).coalesce(1).write.parquet(source)
    assert run() == []
    batch(spark, ("u3", "c", True, 1, 22), ("u4", "d", True, 3, 12), ahead=ahead).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("2024-01-01", 3)]
    # Too late: the day was sent out.
    batch(spark, ("u5", "e", True, 1, 22), ("u4", "f", True, 5, 12), ahead=ahead).coalesce(1).write.mode("append").parquet(source)
    assert run() == [("2024-01-01", 3), ("2024-01-03", 1)]

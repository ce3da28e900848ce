"""Receipts as a stream: daily counts and an up-to-date table of latest responses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import one_per_key
from ..operators.aggregates import daily_receipts
from ..operators.latest import latest_active
from ..scratch import small_table
from ..sources.versioned import CommitConflict, Store, Transaction


def stream_daily_receipts(receipts: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Responses per calendar day; a day is final once the watermark has passed its end.

    Works in append mode: state holds one count per open day, and responses later than
    the watermark no longer change a day that was sent out. ``start_daily_receipts``
    has the complete counts, late responses and open days included.
    """
    # Windows of a day start at midnight UTC, so the local clock time is put on that scale.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    clock = F.timestamp_diff("MICROSECOND", epoch, F.col("received_at").cast("timestamp_ntz"))
    rows = receipts.where(F.col("received_at").isNotNull()).select(F.timestamp_micros(clock).alias("received_at"))
    days = F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int")
    return (
        rows.withWatermark("received_at", watermark)
        .groupBy(F.window("received_at", "1 day").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.date_add(F.lit("1970-01-01").cast("date"), days).alias("day"), "n")
    )


def start_daily_receipts(receipts: DataFrame, target: str, checkpoint: str, **trigger):
    """Start a stream of complete daily counts; read them with ``read_daily_receipts``.

    Late responses and open days count: there is no watermark, as the state is one count
    per day and grows by the calendar only. Every batch sends the days that changed with
    their new counts, and the sink puts them in place of the old ones in the commit that also
    notes the batch, so a repeated batch changes nothing.
    """
    days = receipts.where(F.col("received_at").isNotNull()).groupBy(F.to_date("received_at").alias("day")).agg(F.count("*").alias("n"))
    writer = days.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(_daily_writer(target, checkpoint))
    return (writer.trigger(**trigger) if trigger else writer).start()


def _daily_writer(target: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, target)
        writer = _stream_id(batch.sparkSession, checkpoint)

        def change(t: Transaction) -> None:
            part = F.lit(writer).alias("writer")
            if "days" not in t.base.tables:
                t.create("days", batch.select("day", "n", part), ["writer"])
                return
            # a stream counts from its own start: streams side by side add up
            mine = batch.select(part).limit(1)
            old = t.read("days", mine).join(batch.select("day"), "day", "left_anti")
            t.replace("days", old.unionByName(batch.select("day", "n", part)), mine)

        if not batch.isEmpty():
            _once(store, writer, batch_id, change)

    return write


def read_daily_receipts(spark: SparkSession, target: str) -> DataFrame | None:
    """Responses per day of all streams that count into ``target``; None before the first batch."""
    store = Store(spark, target)
    if "days" not in store.manifest().tables:
        return None
    return store.read("days").groupBy("day").agg(F.sum("n").alias("n"))


# --- the state of every response -----------------------------------------------------------

# Responses lie in folders by the hash of their unit. A batch adds a folder of level 0 to the
# buckets it touches; as soon as a bucket has a certain number of folders of one level, these
# are merged into one of the next level, newest state per response. So a merge reads and writes
# only those folders, and a row is written again once per level.

TABLE = "receipts"


def latest_active_writer(
    target: str, compact_every: int = 20, checkpoint: str | None = None, buckets: int = 16
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps all responses at ``target``, newest state each.

    Batches are commits of a versioned table (``sources.versioned``). The target numbers
    them, and notes the last batch of every writer in the same commit: a batch that is
    repeated after a failure is passed over. A writer is a stream, known by its
    ``checkpoint``; without one, every call makes a new writer, whose batches are always
    added and never written over others.

    ``buckets`` counts when the table is made. Inactive responses are kept, so that
    switching a response off brings back the unit's earlier one. Of rows of one response in
    one batch the latest received counts; of equal times, an inactive one.
    """
    own = uuid.uuid4().hex

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, target)
        writer = own if checkpoint is None else _stream_id(spark, checkpoint)

        def change(t: Transaction) -> None:
            n = int(t.base.notes.get("buckets", buckets))
            t.note("buckets", str(n))
            rows = batch.withColumn("__b", F.lit(t.base.version + 1))
            rows = _newest_state(rows).withColumn("__bucket", _bucket(n))
            if TABLE in t.base.tables:
                t.append(TABLE, rows, "-L0")
            else:
                t.create(TABLE, rows.limit(0), ["__bucket"])
                t.append(TABLE, rows, "-L0")

        if _once(store, writer, batch_id, change):
            _merge_levels(store, compact_every)

    return write


def _bucket(n: int, unit: str = "unit") -> Column:
    return F.pmod(F.xxhash64(F.col(unit).cast("string")), F.lit(n)).cast("int")


def _once(store: Store, writer: str, batch_id: int, change: Callable[[Transaction], None]) -> bool:
    """Commit a change as batch ``batch_id`` of ``writer``, unless that is done; False if it was."""
    while True:
        t = store.begin()
        if int(t.base.notes.get(f"writer-{writer}", -1)) >= batch_id:
            return False
        change(t)
        t.note(f"writer-{writer}", str(batch_id))
        try:
            t.commit(f"batch {batch_id} of {writer}", strict=True)
            return True
        except CommitConflict:
            continue  # another writer was faster: once more, on top of its state


def _level(folder: str) -> int:
    return int(folder.split("/", 1)[0].rsplit("-L", 1)[1])


def _merge_levels(store: Store, every: int, keep_versions: int = 3) -> None:
    """Merge the folders of every level of a bucket that has ``every`` of them."""
    level = 0
    merged = False
    while True:
        t = store.begin()
        parts = t.base.tables[TABLE].parts
        due = {p: fs for p, folders in parts.items() if len(fs := [f for f in folders if _level(f) == level]) >= every}
        if due:
            t.merge(TABLE, due, lambda old: _newest_state(old), f"-L{level + 1}")
            try:
                t.commit(f"merge level {level}")
                merged = True
            except CommitConflict:
                pass  # another writer merged them
        if level >= max((_level(f) for fs in parts.values() for f in fs), default=0):
            break
        level += 1
    if merged:
        store.clean_up(keep_versions)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint; a fresh checkpoint has another."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def stream_latest_active(receipts: DataFrame, target: str, checkpoint: str, compact_every: int = 20, **trigger):
    """Start the stream; read the result with ``current_latest_active`` or ``current_daily_receipts``."""
    writer = receipts.writeStream.foreachBatch(latest_active_writer(target, compact_every, checkpoint))
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def current_responses(spark: SparkSession, target: str, units: Sequence[str] | None = None) -> DataFrame | None:
    """The newest state of every response received so far; None before the first batch.

    With ``units`` only the folders of these units' buckets are read.
    """
    store = Store(spark, target)
    manifest = store.manifest()
    if TABLE not in manifest.tables:
        return None
    if units is None:
        rows = store.read(TABLE, manifest.version)
    else:
        wanted = small_table(spark, [(u,) for u in units], "unit string")
        buckets = {(str(r[0]),) for r in wanted.select(_bucket(int(manifest.notes["buckets"]))).distinct().collect()}
        rows = store.read_parts(TABLE, buckets, manifest.version).join(wanted.distinct(), "unit", "left_semi")
    return _newest_state(rows).drop("__b", "__bucket")


def current_latest_active(spark: SparkSession, target: str, units: Sequence[str] | None = None, **options) -> DataFrame | None:
    """``latest_active`` over everything received so far; None before the first batch."""
    rows = current_responses(spark, target, units)
    return None if rows is None else latest_active(rows, **options)


def current_daily_receipts(spark: SparkSession, target: str) -> DataFrame | None:
    """Responses per day over everything received so far; None before the first batch.

    A response that came in twice counts once, on the day of its newest state;
    ``start_daily_receipts`` counts what came in.
    """
    rows = current_responses(spark, target)
    return None if rows is None else daily_receipts(rows)


def _newest_state(rows: DataFrame) -> DataFrame:
    """One row per response: the state from the latest batch."""
    key = [c for c in ("period", "form", "unit", "ref") if c in rows.columns]
    order = [F.col("__b").desc(), F.col("received_at").desc_nulls_last(), F.col("active").asc()]
    return one_per_key(rows, key, order)

"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "table", "small_batches", "crc_of_id", "word_spans", "word_hashes", "shingle_hashes", "mix",
           "texts_of", "bounded_parts", "best_of_groups"]

#: Words of a shingle, and the similarity from which documents count as near copies.
SHINGLE_WORDS = 5
NEAR_PERCENT = 80
#: Rows of an Arrow batch where texts go to Python: a few megabytes, in the task and in its worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands at most ``BATCH_ROWS`` rows at once to Python; a smaller setting stays. It changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def crc_of_id(key: str) -> Column:
    """CRC-32 of the id written as decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes."""
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, all words of a batch together."""
    h = (ends - starts).astype(np.uint64) * _GOLDEN
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    live, at = np.arange(len(starts)), starts.copy()
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    masks = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [0xFFFFFFFFFFFFFFFF], np.uint64)
    with np.errstate(over="ignore"):
        while len(live):
            left = ends[live] - at[live]
            word = np.ascontiguousarray(eight[at[live]]).view(np.uint64).ravel()
            word &= masks[np.minimum(left, 8)]
            h[live] = mix((h[live] ^ word) * _GOLDEN + _M2)
            live = live[left > 8]
            at[live] += 8
    return h


word_hashes = _word_hashes


def bounded_parts(rows: DataFrame, key: str, weight: str, bound: int) -> tuple[DataFrame, int]:
    """Stored ``rows`` (``key`` is unique) with a column ``part``, and the number of parts.

    No part weighs more than ``bound`` unless it is a single row: this is counted, and the
    number of parts doubles until it holds.
    """
    rows = materialize(rows)
    total = rows.agg(F.sum(weight)).first()[0] or 0
    parts = max(1, -(-total // bound))
    while True:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64(key, F.lit(parts)), F.lit(parts)))
        size = dealt.groupBy("part").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).where("n > 1").agg(F.max("w"))
        if (size.first()[0] or 0) <= bound:
            return dealt, parts
        parts *= 2


def best_of_groups(group: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each group by higher score, then smaller ``tie``; groups ascend."""
    order = np.lexsort((tie, -score, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return order[rank < k]


def _batches(texts: Sequence[bytes], limit: int) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def shingle_hashes(texts: Sequence[bytes], words: int = SHINGLE_WORDS, limit: int = 1 << 18) -> Iterator[np.ndarray]:
    """Per text the 64-bit hashes of all its word shingles, in order and with repeats.

    A-Z is lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. A text of
    fewer words than a shingle gives one hash of the whole sequence, an empty one none.
    """
    for lo, hi in _batches(texts, limit):
        data = _LOWER[np.frombuffer(b" ".join(texts[lo:hi]), np.uint8)]
        starts, ends = word_spans(data)
        h = _word_hashes(data, starts, ends)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        first = np.searchsorted(starts, offsets)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
            for k in range(words):
                rolled = rolled * _GOLDEN + h[k:len(h) - words + 1 + k] if len(rolled) else rolled
            rolled = mix(rolled)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield rolled[a:b - words + 1]
            elif b > a:
                one = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        one = one * _GOLDEN + x
                yield mix(np.array([one], np.uint64))
            else:
                yield np.zeros(0, np.uint64)

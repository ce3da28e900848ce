"""Hard-negative mining by threshold joins with an inverted index, after the L2AP method.

Anchors are compared with all rows, block of anchors by block, as joins under a threshold:
which rows have an inner product of at least ``t`` with the anchor? A window of an anchor (a
range of scores, of which the highest ``k`` are wanted) is full when ``k`` rows were found;
for the anchors whose windows are not full the threshold is lowered, at last to the windows'
own lower ends, so nothing is lost.

Within a batch of rows the dimensions are ordered and cut into segments. A row is indexed under
its first segments only: the rest is omitted once the norm of the row's rest times the largest
norm of the anchors' rests is below the threshold, for such a rest alone reaches nothing. The
scores of the postings are accumulated segment by segment, and a pair is dropped as soon as
its partial score plus the product of the remaining norms stays below the anchor's
threshold. Only surviving pairs are completed, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import best_of_groups, bounded_parts, materialize, table

#: Bytes of the vectors of one block of anchors, rows of a batch, anchors compared at once.
BLOCK_BYTES, BATCH_ROWS, ANCHORS_AT_ONCE = 8 << 20, 8192, 128
#: Dimensions of a segment of the index; from which share of live pairs on the pairs are completed one by one.
SEGMENT, SPARSE = 16, 1 / 16
#: Thresholds of the rounds: of a positive as shares of the largest possible score, of a
#: negative as shares of the upper end of its lowest window. The last round has the lower ends.
POSITIVE_ROUNDS, NEGATIVE_ROUNDS = (0.5, 0.25), (0.8, 0.55)
#: Squared norms from here on would leave 64-bit scores.
NORM_LIMIT = float(1 << 58)


def scaled(rows: DataFrame, key: str, vector: str, label: Column, scale: int = 256) -> DataFrame:
    """(id, label, v) with ``v`` the floors of the scaled components, of the rows that take part.

    Rows with a null id, label, vector or component, with a component that is not finite, an
    empty vector, or a vector too long for 64-bit scores take no part.
    """
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    finite = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (
        rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
        .select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
        .where("label is not null and size(v) > 0").withColumn("norm2", squares).where(F.col("norm2") < NORM_LIMIT)
    )


@dataclass
class Anchors:
    """A block of anchors: their windows (``low`` to ``high``, none where low > high), and thresholds."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    threshold: np.ndarray

    def only(self, rows: np.ndarray) -> "Anchors":
        return Anchors(*(getattr(self, f)[rows] for f in ("ids", "labels", "vectors", "low", "high", "threshold")))


def _exact_type(largest: float):
    """Number type in which all partial scores are exact: they are at most the product of the norms."""
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    flat, lens = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if len(lens) and (lens == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lens), dims))
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def _rest_norms(x: np.ndarray, segments: list[slice]) -> np.ndarray:
    """Per row the norms of what is left from each segment on, and 0 behind the last; rounded up."""
    squares = np.stack([np.square(x[:, s].astype(float)).sum(axis=1) for s in segments], axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((rest, np.zeros((len(x), 1))), axis=1)) * (1 + 1e-9)


class Index:
    """Inverted index of a batch of rows: per segment the leading rows that are indexed under it."""

    def __init__(self, x: np.ndarray, segments: list[slice], least: float, anchor_rest: np.ndarray):
        rest = _rest_norms(x, segments)
        needed = rest[:, :-1] * anchor_rest[:-1] >= least  # an omitted rest cannot reach a threshold
        depth = np.where(needed.any(axis=1), needed.shape[1] - np.argmax(needed[:, ::-1], axis=1), 0)
        self.rows = np.argsort(-depth, kind="stable")
        self.rows = self.rows[depth[self.rows] > 0]
        self.depth, self.rest = depth[self.rows], rest[self.rows]
        x = x[self.rows]
        self.postings = [np.ascontiguousarray(x[:int((self.depth > k).sum()), s]) for k, s in enumerate(segments)]
        self.x = x


def pairs_over(index: Index, a: np.ndarray, rest: np.ndarray, threshold: np.ndarray, segments: list[slice]):
    """(anchor, row, score) of all pairs that reach the anchor's threshold."""
    score = np.zeros((len(a), len(index.rows)), a.dtype)
    bar, all_rows = threshold[:, None], np.arange(len(index.rows))
    for k, s in enumerate(segments):
        n = len(index.postings[k])
        score[:, :n] += a[:, s] @ index.postings[k].T
        done = np.minimum(index.depth, k + 1)  # segments that are in the row's scores
        live = score + rest[:, done] * index.rest[all_rows, done] >= bar
        if k + 1 == len(segments) or not len(index.postings[k + 1]) or np.count_nonzero(live) < SPARSE * live.size:
            break
    i, j = np.nonzero(live)
    value, done = score[i, j], done[j]
    for k, s in enumerate(segments):
        missing = done <= k
        if missing.any():
            value[missing] += np.einsum("ij,ij->i", a[i[missing], s], index.x[j[missing], s])
            done = np.maximum(done, k + 1)
            keep = value + rest[i, done] * index.rest[j, done] >= threshold[i]
            i, j, value, done = i[keep], j[keep], value[keep], done[keep]
    keep = value >= threshold[i]
    return i[keep], index.rows[j[keep]], value[keep]


def _search(rows: DataFrame, anchors: Anchors, same_label: bool, k: int, dims: int, largest: float) -> DataFrame:
    """(anchor, window, id, score): per window the best ``k`` rows that reach the anchor's threshold.

    ``anchor`` is the position in the block. Per task at most ``k`` rows of a window are kept.
    """
    spark = rows.sparkSession
    kind = _exact_type(largest)
    shared = spark.sparkContext.broadcast(anchors)

    def run(batches):
        of = shared.value
        windows = of.low.shape[1]
        none = np.zeros(0, np.int64)
        kept = none, none, none
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(lo, BATCH_ROWS)
                ids, labels = (part.column(c).to_numpy() for c in (0, 1))
                x = _matrix(part.column(2), dims).astype(kind)
                order = np.argsort(-np.square(x.astype(float)).sum(axis=0), kind="stable")
                segments = [slice(s, s + SEGMENT) for s in range(0, dims, SEGMENT)]
                x, a = x[:, order], of.vectors[:, order].astype(kind)
                rest = _rest_norms(a, segments)
                index = Index(x, segments, of.threshold.min(), rest.max(axis=0))
                found = [kept]
                for first in range(0, len(a), ANCHORS_AT_ONCE):
                    block = slice(first, first + ANCHORS_AT_ONCE)
                    i, j, score = pairs_over(index, a[block], rest[block], of.threshold[block], segments)
                    i, score = i + first, score.astype(np.int64)
                    ok = (of.labels[i] == labels[j]) == same_label
                    ok &= of.ids[i] != ids[j]
                    i, j, score = i[ok], j[ok], score[ok]
                    for w in range(windows):
                        fits = (score >= of.low[i, w]) & (score <= of.high[i, w])
                        found.append((i[fits] * windows + w, score[fits], ids[j[fits]]))
                kept = tuple(np.concatenate(c) for c in zip(*found))
                best = best_of_groups(*kept, k)
                kept = tuple(c[best] for c in kept)
        for lo in range(0, len(kept[0]), 1 << 16):
            group, score, found_id = (c[lo:lo + (1 << 16)] for c in kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group // windows), pa.array((group % windows).astype(np.int32)), pa.array(found_id), pa.array(score)],
                names=["anchor", "window", "id", "score"])

    found = rows.select("id", "label", "v").mapInArrow(run, "anchor long, window int, id long, score long")
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)


def _fill(rows: DataFrame, anchors: Anchors, starts: Sequence[np.ndarray], same_label: bool, k: int, dims: int,
          largest: float) -> DataFrame | None:
    """Results of all windows: thresholds are lowered from round to round until the windows are full."""
    valid = anchors.low <= anchors.high
    lower_end = np.where(valid, anchors.low, 1 << 62).min(axis=1).astype(float)
    if largest >= 1 << 53:  # beyond exact doubles; the windows themselves are compared as integers
        lower_end -= np.abs(lower_end) * 1e-12
    todo = np.flatnonzero(valid.any(axis=1))
    out = None
    for turn in range(len(starts) + 1):
        if not len(todo):
            break
        last = turn == len(starts)
        some = anchors.only(todo)
        some.threshold = lower_end[todo] if last else np.maximum(starts[turn][todo], lower_end[todo])
        found = materialize(_search(rows, some, same_label, k, dims, largest))
        counts = np.zeros(some.low.shape, np.int64)
        if not last:
            c = found.groupBy("anchor", "window").agg(F.count("*").alias("n")).toArrow()
            counts[c.column("anchor").to_numpy(), c.column("window").to_numpy()] = c.column("n").to_numpy()
        full = ((counts >= k) | ~valid[todo]).all(axis=1) | (some.threshold <= lower_end[todo])
        done = np.flatnonzero(full)
        names = rows.sparkSession.createDataFrame(pa.table({"anchor": pa.array(done), "anchor_id": pa.array(some.ids[done])}))
        kept = found.join(names, "anchor").drop("anchor")
        out = kept if out is None else out.union(kept)
        todo = todo[~full]
    return out


def mine(rows: DataFrame, is_anchor: Column, key: str = "id", vector: str = "vector", label: Column | str = "label",
         positives: int = 5, negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: int = 256,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of every anchor the ``positives`` best other rows of its label, and for each the first
    ``negatives`` rows of other labels whose score lies between ``low_percent`` and
    ``high_percent`` of the positive's; higher scores first, equal ones by smaller id. A
    positive with a negative score has no such rows. Components are floors of the scaled
    values, so scores are exact integers.

    Rows with a null id, label, vector or component, or with a component that is not
    finite, take no part. A row counts as often as it occurs; rows with the anchor's id are no
    partners of it, and of several anchors with one id the smallest (label, vector) counts.
    Shorter vectors are filled up with zeros. An empty table gives no rows, and further
    columns are not read.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    anchors = scaled(rows.where(is_anchor), key, vector, label, scale)
    rows = materialize(scaled(rows, key, vector, label, scale))
    dims, largest = rows.agg(F.max(F.size("v")), F.max("norm2")).first()
    empty = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if dims is None:
        return empty
    anchors = anchors.groupBy("id").agg(F.min(F.struct("label", "v")).alias("a")).select("id", "a.label", "a.v")
    dealt, parts = bounded_parts(anchors.withColumn("bytes", F.lit(8 * dims)), "id", "bytes", block_bytes)
    out = empty
    for part in range(parts):
        block = dealt.where(F.col("part") == part).select("id", "label", "v").orderBy("id").toArrow().combine_chunks()
        if not block.num_rows:
            continue
        ids, labels = (block.column(c).to_numpy() for c in ("id", "label"))
        vectors = _matrix(block.column("v").combine_chunks(), dims)
        norms = np.sqrt(np.square(vectors).sum(axis=1))
        any_low, any_high = np.zeros((len(ids), 1), np.int64), np.full((len(ids), 1), 1 << 62)
        base = Anchors(ids, labels, vectors, any_low, any_high, np.zeros(len(ids)))
        close = _fill(rows, base, [norms * np.sqrt(largest) * f for f in POSITIVE_ROUNDS], True, positives, dims, largest)
        close = materialize(close.select("anchor_id", F.col("r").alias("nth"), F.col("id").alias("positive_id"),
                                         F.col("score").alias("positive_score")))
        known = close.toArrow()
        low, high = np.ones((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        at, nth = np.searchsorted(ids, known.column("anchor_id").to_numpy()), known.column("nth").to_numpy() - 1
        score = known.column("positive_score").to_numpy()
        low[at, nth], high[at, nth] = -(-low_percent * score // 100), high_percent * score // 100
        top = np.where(low <= high, high, 1 << 62).min(axis=1).astype(float)
        wide = Anchors(ids, labels, vectors, low, high, np.zeros(len(ids)))
        far = _fill(rows, wide, [top * f for f in NEGATIVE_ROUNDS], False, negatives, dims, largest)
        if far is not None:
            far = far.select("anchor_id", (F.col("window") + 1).alias("nth"), F.col("r").alias("rank"),
                             F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            out = out.union(close.join(far, ["anchor_id", "nth"]).select(*empty.columns))
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, key="vec_id", vector="embedding", label=label)


SQL = """
WITH parted AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM parted a JOIN parted r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) <= 10
"""

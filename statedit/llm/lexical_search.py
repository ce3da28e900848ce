"""Ranked lexical search of benchmark items over all documents, with bag deduplication.

A ranking depends on a document only through its length part ``m`` and the frequencies of
the terms that occur in items. So the documents are restricted to the vocabulary of the
items; documents with equal term vectors and equal ``m`` are one class (grouped by a hash,
verified by the vectors themselves); every class is scored once; and the winning classes are
expanded to their members in the order of ``doc_id``.

The items go through in slices of bounded size, so that the vocabulary and its postings fit
in every task whatever the number of items. Scoring keeps the best classes of each item per
task, never a row per document and item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import best_of_groups, bounded_parts, materialize, table, texts_of, word_hashes

#: Text bytes of the items of one slice; a single longer item is a slice of its own.
SLICE_BYTES = 8 << 20
#: Text bytes whose terms are found at once, and cells of a table of scores.
CHUNK_BYTES, CELLS = 1 << 18, 1 << 21
TOP = 10

#: 0-9, A-Z, a-z and all bytes of characters beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LAST = np.int64(2 ** 63 - 1)


def term_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of term bytes."""
    edge = np.diff(np.concatenate(([False], _TERM[data], [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def terms_of(text: str | None) -> list[bytes]:
    data = _LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(*term_spans(data))]


class Vocabulary:
    """Terms by hash; a hit counts only if its bytes are the term's."""

    def __init__(self, terms: list[bytes]):
        lens = np.array([len(t) for t in terms], np.int64)
        self.data = np.frombuffer(b"".join(terms) + bytes(8), np.uint8)
        self.starts = np.cumsum(lens) - lens
        self.lens = lens
        hashes = word_hashes(self.data, self.starts, self.starts + lens)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.longest = int(lens.max(initial=0))
        runs = np.unique(self.hashes, return_counts=True)[1]
        self.same_hash = int(runs.max(initial=0))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Term number of each span of ``data``, or -1."""
        found = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(ends - starts <= self.longest)
        if not len(short):
            return found
        starts, lens = starts[short], (ends - starts)[short]
        hashes = word_hashes(data, starts, starts + lens)
        at = np.searchsorted(self.hashes, hashes)
        for step in range(self.same_hash):
            slot = np.minimum(at + step, len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[slot] == hashes)
            term = self.order[slot[hit]]
            same = self._equal(data, starts[hit], lens[hit], term)
            found[short[hit[same]]] = term[same]
        return found

    def _equal(self, data, starts, lens, term) -> np.ndarray:
        same = self.lens[term] == lens
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            differ = data[starts[live] + k] != self.data[self.starts[term[live]] + k]
            same[live[differ]] = False
            k += 1
            live = live[~differ & (lens[live] > k)]
        return same


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (text number, piece) of bounded size; long texts are cut between terms."""
    numbers, group, size = [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            end = min(len(t), at + CHUNK_BYTES)
            while end < len(t) and _TERM[t[end]]:
                end += 1
            numbers.append(i)
            group.append(t[at:end])
            size += end - at
            at = max(end, at + 1)
            if size >= CHUNK_BYTES:
                yield numbers, group
                numbers, group, size = [], [], 0
    if group:
        yield numbers, group


def bags(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n, bag): all terms of a document, and its vector over the vocabulary.

    ``bag`` packs (term, frequency) pairs of 32-bit numbers in the order of terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        vocab = shared.value
        size = max(1, len(vocab.lens))
        n, keys = np.zeros(len(texts), np.int64), []
        for numbers, group in _pieces(texts):
            data = _LOWER[np.frombuffer(b" ".join(group), np.uint8)]
            starts, ends = term_spans(data)
            offsets = np.cumsum([len(p) + 1 for p in group])
            which = np.array(numbers)[np.searchsorted(offsets, starts, side="right")] if len(starts) else starts
            n += np.bincount(which, minlength=len(texts))
            term = vocab.find(data, starts, ends)
            known = term >= 0
            keys.append(np.stack(np.unique(which[known] * size + term[known], return_counts=True)))
        key, times = np.concatenate(keys, axis=1) if keys else np.zeros((2, 0), np.int64)
        key, back = np.unique(key, return_inverse=True)
        freq = np.bincount(back, weights=times, minlength=len(key)).astype(np.int64)
        cut = np.searchsorted(key // size, np.arange(len(texts) + 1))
        pairs = np.stack((key % size, freq), axis=1).astype(np.int32)
        return n, [pairs[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                n, packed = count(texts_of(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(packed, pa.binary())], names=["doc_id", "n", "bag"])

    return docs.mapInArrow(run, "doc_id long, n long, bag binary")


def _statistics(stored: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms of all documents, documents per vocabulary term)."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            df += np.bincount(np.frombuffer(joined, np.int32).reshape(-1, 2)[:, 0], minlength=size)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(df[hit])], names=["term", "df"])

    total, length = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = stored.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[out.column("term").to_numpy()] = out.column("df").to_numpy()
    return total, length, df


def _weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Postings:
    """Per term the items it occurs in and how often, and its weight."""

    def __init__(self, items: list[Counter], numbers: dict[bytes, int]):
        entries = sorted((numbers[t], i, c) for i, bag in enumerate(items) for t, c in bag.items())
        term, self.item, self.times = np.array(entries, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(term, np.arange(len(numbers) + 1))
        self.items = len(items)
        self.longest = max((sum(c.values()) for c in items), default=0)
        self.weights = np.zeros(len(numbers), np.int64)

    def scores(self, of: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, classes: int) -> np.ndarray:
        """Table (class, item) of scores from the entries (class, term, frequency, m)."""
        part = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
        size = self.first[term + 1] - self.first[term]
        entry = np.repeat(np.arange(len(term)), size)
        at = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + self.first[term][entry]
        cell = of[entry] * self.items + self.item[at]
        value = part[entry] * self.times[at]
        if int(part.max(initial=0)) * self.longest < 1 << 53:  # sums of doubles are exact
            total = np.bincount(cell, weights=value, minlength=classes * self.items).astype(np.int64)
        else:
            total = np.zeros(classes * self.items, np.int64)
            np.add.at(total, cell, value)
        return total.reshape(classes, self.items)


def _best_classes(classes: DataFrame, postings: Postings, top: int) -> DataFrame:
    """(item, score, first, h): per task the best classes of each item, equal scores by smallest id."""
    shared = classes.sparkSession.sparkContext.broadcast(postings)

    def run(batches):
        p = shared.value
        none = np.zeros(0, np.int64)
        kept = none, none, none, none
        rows = max(1, CELLS // max(1, p.items))
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                first, h, m = (part.column(k).fill_null(int(_LAST)).to_numpy() for k in range(3))
                packed = part.column(3).to_pylist()
                pairs = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2).astype(np.int64)
                of = np.repeat(np.arange(len(packed)), [len(b) // 8 for b in packed])
                scores = p.scores(of, pairs[:, 0], pairs[:, 1], m[of], len(packed))
                lowest = np.full(p.items, _LAST)
                np.minimum.at(lowest, kept[0], kept[1])
                least = np.where(np.bincount(kept[0], minlength=p.items) >= top, lowest, 0)
                at, item = np.nonzero((scores > 0) & (scores >= least))
                kept = tuple(np.concatenate(x) for x in zip(kept, (item, scores[at, item], first[at], h[at])))
                keep = best_of_groups(kept[0], kept[1], kept[2], top)
                kept = tuple(x[keep] for x in kept)
        for i in range(0, len(kept[0]), 1 << 16):
            item, score, first, h = (x[i:i + (1 << 16)] for x in kept)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item), pa.array(score), pa.array(first, mask=first == _LAST), pa.array(h)],
                names=["item", "score", "first", "h"])

    found = classes.select("first", "h", "m", "bag").mapInArrow(run, "item long, score long, first long, h long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).drop("r")


def _rank_slice(docs: DataFrame, items: list[tuple[int, Counter]], top: int) -> DataFrame:
    spark = docs.sparkSession
    terms = sorted({t for _, bag in items for t in bag})
    stored = materialize(bags(docs, Vocabulary(terms)))
    documents, length, df = _statistics(stored, len(terms))
    postings = Postings([bag for _, bag in items], {t: i for i, t in enumerate(terms)})
    postings.weights = _weights(df, documents)
    wide = "cast(n as decimal(19,0))"
    m = F.expr(f"cast(100 - 75 + ((75 * {wide} * cast({documents} as decimal(15,0))) div {max(1, length)}) as bigint)")
    vectors = stored.where("length(bag) > 0").withColumn("m", m).withColumn("h", F.xxhash64("bag", "m"))
    classes = materialize(vectors.groupBy("h", "bag", "m").agg(F.min("doc_id").alias("first")))
    best = materialize(_best_classes(classes, postings, top))
    # expand: a class gives an item at most ``top`` members, those with the smallest ids
    same_first = F.col("first").eqNullSafe(F.col("__first"))
    won = classes.join(best.select(F.col("h").alias("__h"), F.col("first").alias("__first")).distinct(),
                       (F.col("h") == F.col("__h")) & same_first).drop("__h", "__first")
    members = vectors.join(won, ["h", "bag", "m"]).select("h", "first", "doc_id")
    order = Window.partitionBy("h", "first").orderBy(F.asc_nulls_last("doc_id"))
    members = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    members = members.select(F.col("h").alias("__h"), F.col("first").alias("__first"), "doc_id")
    hits = best.join(members, (F.col("h") == F.col("__h")) & same_first)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame(pa.table({
        "item": pa.array(range(len(items)), pa.int64()), "item_id": pa.array([i for i, _ in items], pa.int64())}))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).join(names, "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item.

    Every row of ``docs`` is a document, repeated rows too; a null or empty text has no
    terms and never scores. A null ``doc_id`` takes part and comes last among equal scores.
    The terms of several different texts of one item id, null among the ids, count together;
    repeated rows of items count once. Items without terms, and empty tables, give no rows.
    Further columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    joined = items.distinct().groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("text"))
    dealt, parts = bounded_parts(joined.withColumn("bytes", F.octet_length("text") + 1), "item_id", "bytes", slice_bytes)
    out = None
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).select("item_id", "text").toArrow()
        bag = [(i, Counter(terms_of(t))) for i, t in zip(*(c.to_pylist() for c in rows.columns))]
        bag = sorted(((i, b) for i, b in bag if b), key=lambda x: (x[0] is None, x[0] or 0))
        if bag:
            ranked = _rank_slice(docs, bag, top)
            out = ranked if out is None else out.union(ranked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH found AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
freq AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY 1, 2),
lens AS MATERIALIZED (SELECT doc_id, sum(tf) AS n FROM freq GROUP BY 1),
total AS MATERIALIZED (SELECT count(*) AS docs, sum(n) AS len FROM lens),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
wanted AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM asked GROUP BY 1, 2),
weight AS MATERIALIZED (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM freq GROUP BY 1) CROSS JOIN total),
scored AS (
    SELECT item_id, doc_id,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + CAST((75 * n * docs) // len AS BIGINT))))) AS BIGINT) AS score
    FROM wanted JOIN freq USING (term) JOIN weight USING (term) JOIN lens USING (doc_id) CROSS JOIN total GROUP BY 1, 2),
ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

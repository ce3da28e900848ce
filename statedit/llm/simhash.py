"""SimHash fingerprints of documents and the search of fingerprints within a Hamming radius.

The terms of a text are its distinct word shingles, weighted by 1 + ln(occurrences). Every
term hash votes with its weight on each bit, up for a one and down for a zero; the signs are
the fingerprint. The share of equal bits of two fingerprints estimates the angle between the
weighted term vectors, so the likeness is its cosine.

For the search a fingerprint is cut into blocks. Two fingerprints within ``radius`` bits
agree on one of ``radius + 1`` blocks, so one table per block, with that block moved to the
front as key, finds all of them; candidates are then compared in full. In a crowded key the
remaining blocks are cut once more in the same way, which again loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import small_table
from .common import SHINGLE_WORDS, materialize, mix, shingle_hashes, table, texts_of

#: Bits of a fingerprint (a multiple of 64), and the radius of the search.
BITS, RADIUS = 128, 3
#: Fingerprints under one key from which the key is refined.
CROWD = 200


def fingerprints(texts: list[bytes], bits: int = BITS, words: int = SHINGLE_WORDS) -> np.ndarray:
    """One row of ``bits`` / 8 bytes per text; a text without words has all bits clear."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    for i, h in enumerate(shingle_hashes(texts, words)):
        if not len(h):
            continue
        terms, count = np.unique(h, return_counts=True)
        weight = (1 + np.log(count)).astype(np.float32)
        planes = [terms, *[mix(terms + np.uint64(k)) for k in range(1, bits // 64)]]
        votes = np.concatenate([
            weight @ np.unpackbits(p.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) for p in planes])
        out[i] = np.packbits(votes * 2 > weight.sum())
    return out


_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated cosine similarity, 0 to 1; 1 for equal fingerprints."""
    differ = _ONES[a ^ b].sum(-1)
    return np.clip(np.cos(np.pi * differ / (8 * a.shape[-1])), 0.0, 1.0)


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as much of the following text's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _judge(ids: list, texts: list[bytes], bits: int) -> pa.RecordBatch:
    """Of all but the last text, which only follows the one before."""
    whole = [t.decode("utf-8", "replace") for t in texts]
    changed = [edited(a, b).encode() for a, b in zip(whole, whole[1:])]
    prints = fingerprints(texts + changed, bits)
    own, new = prints[:len(texts)], prints[len(texts):]
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in whole[:-1]], pa.int64()),
        pa.array([hashlib.sha256(c).hexdigest() for c in changed]),
        pa.array([x.tobytes().hex() for x in own[:-1]]), pa.array([x.tobytes().hex() for x in new]),
        pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Fingerprint every text and its edited text, along descending ids; after the last comes the first.

    The ids are cut into ranges and the texts moved once; the first text of each range goes
    to the range before as well. Null ids follow the others, repeated ids are ordered by
    their texts. A null text is empty: no characters and a clear fingerprint. One document
    follows itself. No documents give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * n
    bounds = rows.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = sorted({int(b) for b in bounds})
    above = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<long>"), lambda b: b <= F.col("doc_id")))
    rows = rows.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(above))
    heads = [(r.range, r.top) for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect()]  # a row per range
    order = sorted(heads, key=lambda h: h[0])
    guests = [(top, at, order[i + 1][0] if i + 1 < len(order) else order[0][0]) for i, (at, top) in enumerate(order)]
    moves = small_table(spark, guests, "top long, range int, goes int")
    heads_ = rows.join(moves, "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    dealt = rows.select("doc_id", "text", "range", F.lit(0).alias("guest")).union(
        heads_.select("doc_id", "text", F.col("goes").alias("range"), F.lit(1).alias("guest")))
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for doc_id, data, guest in zip(part.column(0).to_pylist(), texts_of(part.column(1)), part.column(3).to_pylist()):
                    if guest and not ids:
                        continue  # a repeated row of the head
                    ids.append(doc_id)
                    texts.append(data)
                    size += len(data)
                    if guest or len(ids) > 256 or size > 2_000_000:
                        if len(ids) > 1:
                            yield _judge(ids, texts, bits)
                        ids, texts, size = ([], [], 0) if guest else ([doc_id], [data], 0)

    return dealt.mapInArrow(run, SCHEMA)


def _distance(a: Column, b: Column, bits: int) -> Column:
    """Bits in which two fingerprints in hex differ."""
    word = lambda c, i: F.conv(F.substring(c, 16 * i + 1, 16), 16, -10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(bits // 64)), F.lit(0))


def near_links(prints: DataFrame, radius: int = RADIUS, bits: int = BITS, fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs (a, b, distance) with a < b of different fingerprints at most ``radius`` bits apart.

    ``prints`` may repeat fingerprints; null ones are left out. Exact for every radius below
    the number of hex digits.
    """
    digits, blocks = bits // 4, radius + 1
    cut = [digits * i // blocks for i in range(blocks + 1)]
    f = F.col("f")
    tables = F.array(*[
        F.struct(F.lit(i).alias("t"), F.substring(f, cut[i] + 1, cut[i + 1] - cut[i]).alias("key"),
                 F.concat(F.substring(f, 1, cut[i]), F.substring(f, cut[i + 1] + 1, digits)).alias("rest"))
        for i in range(blocks)])
    distinct = prints.select(F.col(fingerprint).alias("f")).where("f is not null").distinct()
    entries = distinct.select("f", F.inline(tables))
    crowd = materialize(entries.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1"))
    entries = materialize(entries.join(crowd, ["t", "key"]))
    inner = [max(0, digits - digits // blocks - 1) * i // blocks for i in range(blocks)] + [digits]
    again = F.array(*[F.struct(F.lit(i).alias("u"), F.substring("rest", inner[i] + 1, inner[i + 1] - inner[i]).alias("sub")) for i in range(blocks)])
    plain = entries.where(F.col("m") <= CROWD).select("f", "t", "key", F.lit(-1).alias("u"), F.lit("").alias("sub"))
    keyed = plain.union(entries.where(F.col("m") > CROWD).select("f", "t", "key", F.inline(again)))
    pairs = (
        keyed.withColumnRenamed("f", "a").join(keyed.withColumnRenamed("f", "b"), ["t", "key", "u", "sub"]).where("a < b")
        .withColumn("distance", _distance(F.col("a"), F.col("b"), bits)).where(F.col("distance") <= radius)
    )
    return pairs.select("a", "b", "distance").distinct()


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``near_links``: documents of other or equal fingerprints within the radius."""
    judged = materialize(compare_neighbours(table(spark, sf_dir, "documents")))
    counts = materialize(judged.groupBy("fingerprint").agg(F.count("*").alias("c")))
    links = materialize(near_links(counts))
    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.join(counts.withColumnsRenamed({"fingerprint": "b", "c": "n"}), "b").groupBy("a").agg(F.sum("n").alias("n"))
    total = counts.join(near.withColumnRenamed("a", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", (F.col("c") - 1 + F.coalesce("n", F.lit(0))).alias("near_links"))
    return judged.join(total, "fingerprint").select(*judged.columns, "near_links")

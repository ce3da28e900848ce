"""Exact similarity self-join of documents on word shingles, by vertical partitioning.

A document is the set of its hashed shingles. Documents with equal sets are one class. Two
classes link when their Jaccard similarity reaches the threshold. The global order of
shingles is cut into fragments twice:

1. *Filter.* The order is that of the hashes. Of every set only the lowest part (two
   fifths) is looked at, cut into fragments by value; each fragment counts on its own which entries another
   set has as well, and the counts are summed per set. A set that shares too few of its
   entries cannot have a partner. A shingle that repeats within a task is known to be
   shared and sends one witness, so a passage of many documents is not gathered.
2. *Join.* For the sets left, the order is by document frequency, rare first. Sets that
   have a shingle of their prefixes in common are candidates. Per candidate pair and
   fragment the overlap is counted apart, and the counts are summed per pair.

Candidates are taken star by star: in each group of a prefix shingle a few centres are
compared with all others, what links is merged, and only pairs that are still in different
components go on. A group of near copies costs about one comparison each, not all pairs,
and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NEAR_PERCENT, SHINGLE_WORDS, materialize, shingle_hashes, small_batches, table, texts_of
from .components import components

#: Lowest part of a set, in the order of hashes, that the filter looks at.
FILTER_PERCENT = 40
#: Entries of a fragment of the filter, and fragments at least; leading bits of a hash that name the fragment when
#: overlaps are counted.
FRAGMENT_ENTRIES, LEAST_FRAGMENTS, OVERLAP_BITS = 1_000_000, 64, 2
#: Entries that a task gathers before it sends them on, and of those that it places in one go.
TASK_ENTRIES, STEP_ENTRIES = 1_000_000, 1 << 16
#: Bits of the Bloom filter that spares the second read documents without a partner. Its
#: size is fixed; what it lets through by chance is removed by an exact join.
BLOOM_BITS = 1 << 25
#: Pairs within groups, per row of the prefix table and besides, that are looked at in one go; behind the first
#: rounds more, for then most are the same few pairs in many groups, or share too little by their counts.
PAIRS_PER_ROW, LEAST_PAIRS, LATER_PAIRS = 1, 20_000, 256
#: Parity bits per entry of a set, and of a set at most.
PARITY_BITS, MOST_PARITY_BITS = 8, 1 << 14
#: Rounds of stars before that, and rounds with a single centre per group.
STAR_ROUNDS, SINGLE_CENTRE_ROUNDS = 2, 3


def _sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    for h in shingle_hashes(texts, words):
        yield np.unique(h)


def _digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def _ent(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _parity(s: np.ndarray) -> np.ndarray:
    """Of each of a power of two intervals of the low bits whether the set has an odd number of entries there, 64 in a word.

    Where two sets differ in a bit at least one entry is in one of them alone, so the differing
    bits are at most as many as such entries. The second half folded on the first is the
    parity of half as many intervals.
    """
    bits = min(MOST_PARITY_BITS, 1 << max(6, int(PARITY_BITS * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _differing(a: Column, b: Column) -> Column:
    """Differing bits of two parities whose widths are one step apart at most; 0 where they are further apart."""
    half = lambda x: (F.size(x) / 2).cast("int")
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    small = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(x)
    return F.coalesce(F.aggregate(F.zip_with(small(a, b), small(b, a), xor), F.lit(0), lambda n, x: n + F.bit_count(x)), F.lit(0))


def shingle_sets(docs: DataFrame, words: int, with_sets: bool, keep=None) -> DataFrame:
    """Per row its key, the size, digest and 64-bit entity of its set, and the sorted set with its parity.

    ``keep`` tells from a batch which of its rows are wanted; it is asked here, so that a task has one worker.
    """
    schema = "doc_id long, n long, ent long, digest binary" + (", hashes array<long>, parity array<long>" if with_sets else "")

    def run(batches):
        for batch in _slices(batches):
            if keep is not None:
                batch = batch.filter(pa.array(keep(batch)))
                if not batch.num_rows:
                    continue
            sets = list(_sets(texts_of(batch.column(1)), words))
            digests = [_digest(s) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                       pa.array([_ent(d) for d in digests], pa.int64()), pa.array(digests, pa.binary())]
            if with_sets:
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                columns.append(_lists(flat, np.array([len(s) for s in sets])))
                parities = [_parity(s) for s in sets]
                columns.append(_lists(np.concatenate(parities), np.array([len(p) for p in parities])))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "ent", "digest", "hashes", "parity"][:len(columns)])

    return docs.mapInArrow(run, schema)


def _need(n, percent: int):
    """Least overlap of a set of n with any partner: the ceiling of n * percent / 100."""
    return -(-n * percent // 100)


def _lowest(n, percent: int, filter_percent: int):
    """(entries of the filter's part, those of them that a partner shares at least)."""
    part = np.minimum(n, np.maximum(-(-n * filter_percent // 100), n - _need(n, percent) + 1))
    return part, np.maximum(1, n * max(0, filter_percent - (100 - percent)) // 100)


def _fragments(docs: DataFrame, words: int, percent: int, filter_percent: int, fragments: int) -> DataFrame:
    """Entries of the filter: per task and fragment one row of packed arrays.

    ``runs`` holds (entity, entries) pairs of the documents, ``hashes`` the entries; those
    of entity 0 are witnesses. Rows with ``fragment`` null hold counts known in the task.
    """
    schema = "fragment int, hashes binary, runs binary"
    main = max(1, fragments * 4 // 5)
    edge = np.uint64((1 << 64) * min(99, filter_percent + 5) // 100)

    def place(h: np.ndarray) -> np.ndarray:
        low = np.minimum(main - 1, (h / float(edge) * main).astype(np.int64))
        rest = max(1, fragments - main)
        high = main + np.minimum(rest - 1, ((h - edge).astype(float) / float(2 ** 64 - int(edge)) * rest).astype(np.int64))
        return np.where(h < edge, low, high)

    def emit(entities: list[int], parts: list[np.ndarray]):
        doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        h = np.concatenate(parts)
        parts.clear()
        order = np.argsort(h, kind="stable").astype(np.int32)
        h = h[order]
        doc = doc[order]
        del order
        new = np.concatenate(([True], h[1:] != h[:-1]))
        single = new & np.concatenate((new[1:], [True]))
        known = np.bincount(doc[~single], minlength=len(entities))
        ents = np.array(entities, np.int64)
        if known.any():
            some = known > 0
            yield None, known[some].tobytes(), ents[some].tobytes()
        doc[~single] = len(ents)  # the first of a repeated entry goes on as its witness
        h, doc = h[new], doc[new]
        del new, single
        ents = np.append(ents, 0)
        # entries ascend, and so do their fragments: each is put in the order of its documents by itself
        where = np.concatenate([place(h[i:i + STEP_ENTRIES]).astype(np.int32) for i in range(0, len(h), STEP_ENTRIES)])
        cut = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(h)]))):
            if a < b:
                order = np.argsort(doc[a:b], kind="stable")
                ids, counts = np.unique(doc[a:b], return_counts=True)
                yield int(where[a]), h[a:b][order].tobytes(), np.stack((ents[ids], counts)).T.tobytes()

    def rows(batches):
        entities: list[int] = []
        parts: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0
        for batch in _slices(batches):
            for s in _sets(texts_of(batch.column(1)), words):
                if not len(s):
                    continue
                ent = _ent(_digest(s))
                if ent in seen:
                    continue
                seen.add(ent)
                part = s[:int(_lowest(len(s), percent, filter_percent)[0])]
                entities.append(ent)
                parts.append(part.copy())
                size += len(part)
            if size > TASK_ENTRIES:
                yield from emit(entities, parts)
                entities, parts, size = [], [], 0
                seen.clear()
        if parts:
            yield from emit(entities, parts)

    def run(batches):
        for fragment, hashes, runs in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([fragment], pa.int32()), pa.array([hashes], pa.binary()), pa.array([runs], pa.binary())],
                names=["fragment", "hashes", "runs"])

    return docs.mapInArrow(run, schema)


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the fragments in a partition: per entity the entries that another entity has as well.

    Fragments wait in packed form and are unpacked one at a time.
    """
    waiting: dict[int, list[tuple[bytes, bytes]]] = {}

    def send(e: np.ndarray, c: np.ndarray):
        for i in range(0, len(e), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(e[i:i + (1 << 16)]), pa.array(c[i:i + (1 << 16)])], names=["ent", "shared"])

    for batch in batches:
        for fragment, h, runs in zip(*(c.to_pylist() for c in batch.columns)):
            if fragment is None:
                yield from send(np.frombuffer(runs, np.int64), np.frombuffer(h, np.int64))
            else:
                waiting.setdefault(fragment, []).append((h, runs))
    while waiting:
        _, packed = waiting.popitem()
        h = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in packed])
        pairs = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for _, x in packed])
        packed.clear()
        e = np.repeat(pairs[:, 0], pairs[:, 1])
        order = np.lexsort((e, h))
        h, e = h[order], e[order]
        del order
        keep = np.concatenate(([True], (h[1:] != h[:-1]) | (e[1:] != e[:-1])))
        h, e = h[keep], e[keep]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        shared = ~(new & np.concatenate((new[1:], [True]))) & (e != 0)
        yield from send(*np.unique(e[shared], return_counts=True))


def _bloom(spark: SparkSession, ids: DataFrame):
    """A test of ids against a bit table of fixed size, made by an aggregate of its words."""
    pos = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(BLOOM_BITS)) for i in range(2)]
    words = (
        ids.select(F.explode(F.array(*pos)).alias("p"))
        .groupBy(F.expr("cast(p div 64 as int) as w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int))) as bits"))
    ).toArrow()
    bits = np.zeros(BLOOM_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def keep(positions: pa.Array, more: pa.Array) -> np.ndarray:
        ok = np.ones(len(positions), bool)
        for p in (positions, more):
            p = p.to_numpy(zero_copy_only=False)
            ok &= (shared.value[p >> 6] >> (p & 63)) & 1 == 1
        return ok

    return pos, keep


def overlaps(pairs: DataFrame, sets: DataFrame, bits: int = OVERLAP_BITS) -> DataFrame:
    """``pairs`` (a, b, ...) with the overlap of their sets: partial counts per fragment, summed per pair.

    ``sets`` has (ent, hashes); fragments are intervals of the hashes, by their leading bits.
    """
    cut = [F.expr(f"filter(hashes, x -> shiftrightunsigned(x, {64 - bits}) = {i})") for i in range(1 << bits)]
    segments = sets.select("ent", F.posexplode(F.array(*cut)).alias("fragment", "segment"))
    part = (
        pairs.join(segments.withColumnsRenamed({"ent": "a", "segment": "sa"}), "a")
        .join(segments.withColumnsRenamed({"ent": "b", "segment": "sb"}), ["b", "fragment"])
        .select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).alias("part"))
    )
    return part.groupBy(*pairs.columns).agg(F.sum("part").alias("overlap"))


def _prefixes(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Prefix entries (hash, ent, n, own) in the order of document frequency, and the sets cut to shared entries.

    ``own`` counts the entries of a set that no other set has.
    """
    entries = sets.select("ent", "n", F.explode("hashes").alias("hash"))
    often = entries.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    need = F.ceil(F.col("n") * percent / 100)
    cut = materialize(
        entries.join(often, "hash").groupBy("ent", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("s"))
        .where(F.size("s") >= need)
        .select("ent", "n", F.col("s.hash").alias("hashes"), (F.size("s") - need + 1).cast("int").alias("k")))
    prefix = cut.select("ent", "n", (F.col("n") - F.size("hashes")).alias("own"), F.explode(F.slice("hashes", F.lit(1), F.col("k"))).alias("hash"))
    return prefix, cut.select("ent", "hashes")


def linked_components(sets: DataFrame, percent: int = NEAR_PERCENT) -> DataFrame:
    """(ent, comp) of all sets (ent, n, hashes, parity) that are linked with another one.

    A round compares the centre of each group of a prefix shingle with the group's other
    members; the centre is the set with the fewest entries of its own, as an original among
    its copies is. Members that link take over the smallest label around them, and the centre
    leaves the group, for it has no untested partner there. Groups of a single label are
    done, and of groups with the same members one goes on. Once the pairs left in the groups are
    few beside the rows of the start, all of them go on at once, each from the first of
    the groups that have both sets, so a pair is formed once. The parities of two sets bound
    their overlap, so of members that are alike but do not link hardly a pair is counted.
    Groups that do not come together in the first rounds have eight times as many centres in
    each further one.

    An overlap is at most the smaller count of shared entries, so a set that shares too little
    of itself (``low``) cannot link with another such set: of those no pairs are formed.
    """
    spark = sets.sparkSession
    parities = sets.select("ent", "parity")
    prefix, sets = _prefixes(sets, percent)
    low = (F.col("n") - F.col("own")) * (100 + percent) < F.col("n") * 2 * percent
    members = materialize(prefix.withColumn("low", low.cast("int")).withColumn("comp", F.col("ent")))
    rows = members.count()
    tested = spark.createDataFrame([], "a long, b long")
    links = tested
    turn = 0
    while True:
        per = members.groupBy("hash", "comp").agg(
            F.count("*").alias("m"), F.sum("low").alias("l"),
            F.bit_xor(F.xxhash64("ent")).alias("x"), F.bit_xor(F.xxhash64("ent", F.lit(1))).alias("y"))
        across = lambda c: F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c))
        groups = per.groupBy("hash").agg(
            ((across("m") - across("l")) / 2).alias("pairs"), F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        groups = groups.where("pairs > 0").groupBy("m", "x", "y").agg(F.min("hash").alias("hash"), F.first("pairs").alias("pairs"))
        groups = materialize(groups)
        left = groups.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        if not left:
            break
        members = members.join(groups.select("hash"), "hash")
        named = lambda x: [F.col(c).alias(c[0] + x) for c in ("own", "n", "comp", "low")]
        most = F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
        enough = most * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
        both = F.col("na") + F.col("nb")
        alike = (both - _differing(F.col("pa"), F.col("pb"))) * (100 + percent) >= both * 2 * percent
        last = left <= PAIRS_PER_ROW * (1 if turn < STAR_ROUNDS else LATER_PAIRS) * rows + LEAST_PAIRS
        if last:
            members = materialize(members)
            lists = members.groupBy("ent").agg(F.array_sort(F.collect_list("hash")).alias("hs"))
            wide = members.join(lists.join(parities, "ent"), "ent")
            a = wide.select("hash", F.col("ent").alias("a"), *named("a"), F.col("hs").alias("sa"), F.col("parity").alias("pa"))
            b = wide.select(F.col("hash").alias("g"), F.col("ent").alias("b"), *named("b"), F.col("hs").alias("sb"), F.col("parity").alias("pb"))
            once = F.col("hash") == F.array_min(F.array_intersect("sa", "sb"))
            pairs = a.join(b, (F.col("hash") == F.col("g")) & F.expr("a < b and ca <> cb and la + lb < 2") & enough & alike & once)
        else:
            first = Window.partitionBy("hash").orderBy("low", "own", F.xxhash64("ent", F.lit(turn)), "ent")
            several = 8 ** max(0, turn - SINGLE_CENTRE_ROUNDS + 1)
            centres = materialize(members.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= several).drop("__r"))
            wide = lambda x: x.join(parities, "ent") if several > 1 else x.withColumn("parity", F.lit(None))
            a = wide(centres).select("hash", F.col("ent").alias("a"), *named("a"), F.col("parity").alias("pa"))
            b = wide(members).select("hash", F.col("ent").alias("b"), *named("b"), F.col("parity").alias("pb"))
            pairs = a.join(b, "hash").where("ca <> cb and la + lb < 2").where(enough & alike if several > 1 else enough)
        first, second = F.struct("a", "na", "ca"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("cb").alias("ca"))
        pairs = pairs.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y")).select(
            F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.col("x.na").alias("na"), F.col("y.na").alias("nb"),
            F.col("x.ca").alias("ca"), F.col("y.ca").alias("cb")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti") if turn else pairs)
        counted = materialize(overlaps(pairs, sets))
        found = counted.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent).select("a", "b", "ca", "cb")
        links = links.union(found.select("a", "b"))
        if last:
            break
        tested = tested.union(pairs.select("a", "b"))
        both = found.select("ca", "cb").union(found.select("cb", "ca")).toDF("e", "other")
        near = materialize(both.groupBy("e").agg(F.min("other").alias("near")))
        # two steps along the links: to the centre, and from there to the smallest around it
        step = near.select(F.col("e").alias("near"), F.col("near").alias("far"))
        label = near.join(step, "near", "left").select("e", F.least("e", "near", "far").alias("new"))
        rest = members.join(centres.select("hash", "ent"), ["hash", "ent"], "left_anti")
        rest = rest.join(label, F.col("comp") == F.col("e"), "left").select(
            "hash", "ent", "n", "own", "low", F.least("comp", "new").alias("comp"))
        members = materialize(rest)
        turn += 1
    return components(links).toDF("ent", "comp")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                 percent: int = NEAR_PERCENT, filter_percent: int = FILTER_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Sets are compared whole and exactly, up to collisions of 64-bit hashes. A null, empty
    or white text has the empty set and stands alone: its component is its own id. Equal
    sets are one class. Rows with a null id take part and get the component's smallest
    id that is not null. Repeated rows count once. Further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(shingle_sets(docs, words, False))
    classes = rows.where("n > 0").groupBy("digest", "ent").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    entries = rows.agg(F.sum("n")).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, entries * filter_percent // 100 // FRAGMENT_ENTRIES)
    packed = _fragments(docs, words, percent, filter_percent, fragments)
    spread = F.coalesce("fragment", F.abs(F.hash("runs")) % fragments)
    shared = packed.repartition(fragments, spread).mapInArrow(_count_shared, "ent long, shared long").groupBy("ent").agg(F.sum("shared").alias("shared"))
    least = F.greatest(F.lit(1), F.floor(F.col("n") * max(0, filter_percent - (100 - percent)) / 100))
    alive = materialize(classes.join(shared, "ent").where(F.col("shared") >= least).select("digest", "ent", "doc_id"))

    positions, test = _bloom(spark, alive.where("doc_id is not null"))
    again = docs.select("doc_id", "text", *(p.alias(f"p{i}") for i, p in enumerate(positions)))

    def keep(batch):
        return test(batch.column(2), batch.column(3)) | batch.column(0).is_null().to_numpy(zero_copy_only=False)

    sets = shingle_sets(again, words, True, keep).where("n > 0").join(alive.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    comp = linked_components(materialize(sets.select("ent", "n", "hashes", "parity")), percent)

    labelled = rows.join(comp, "ent", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "ent")).alias("label"))
    labelled = materialize(labelled)
    smallest = labelled.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(smallest, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest id.

    Rows are judged one by one, whatever their id: of repeated rows one stays, of several
    texts under one id each is judged by its own links, and a row without an id stays only
    where its component has no id. Texts without words link with nothing and stay.
    """
    node = "__node"
    while node in docs.columns:
        node += "_"
    numbered = materialize(docs.withColumn(node, F.monotonically_increasing_id()))
    classes = near_classes(numbered, key=node).select(F.col("doc_id").alias(node), F.col("component_id").alias("__component"))
    first = Window.partitionBy("__component").orderBy(F.asc_nulls_last("__id"), node)
    rows = numbered.select(node, F.col("doc_id").alias("__id")).join(classes, node)
    kept = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(node)
    return numbered.join(kept, node, "left_semi").select(*docs.columns)

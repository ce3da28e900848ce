"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, names and units become typed placeholders; what remains in lower case is the
template. Template windows of documents and benchmark items are joined by hash. Windows on
one diagonal (the same shift between item and document) are counted together, and the values
in the placeholders along it must be consistent: an item's value always stands against the
same value of the document. So a question with other numbers or names is caught as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Tokens of a window, those of them at least that are no placeholder, and the share of an
#: item's windows that must be found on one diagonal.
WINDOW, LITERALS, COVERAGE = 8, 4, 0.5
#: Tokens of an item at least; fewer say nothing that ordinary text does not say.
SHORTEST = 4
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute",
    "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "miles", "mile", "feet", "foot",
    "inches", "inch", "pounds", "pound", "ounces", "ounce", "litres", "liters", "metres", "meters", "dollars", "dollar", "euros",
    "euro", "cents", "cent", "percent", "degrees", "degree",
)


def typed_tokens(text: Column) -> Column:
    """Lower-cased tokens; placeholders are ``\\x01`` with n, d or u and their value.

    Numbers are digits with inner marks, units the known words right behind one, and names
    capitalised words that do not begin a sentence or line. Other marks are dropped, and so
    are tokens without a letter or digit. Null is an empty array.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "\x01", " ")
    t = F.regexp_replace(t, r"(?<=[^\s.!?:;]\x20)(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", "\x01N$1")
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}\x01])(\p{Nd}+(?:[.,:/]\p{Nd}+)*)", "\x01D$1")
    t = F.regexp_replace(t, r"(?i)(\x01D[\p{Nd}.,:/]*\p{Nd})\s*(" + "|".join(UNITS) + r")(?![\p{L}\p{N}])", "$1 \x01U$2")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s\x01.,:/]+", "")
    t = F.regexp_replace(t, r"[.,:/](?!\p{Nd})|(?<!\p{Nd})[.,:/]", "")
    return F.filter(F.split(t, r"\s+"), lambda x: x != "")


def template(tokens: Column) -> Column:
    """Hash per token; all placeholders of a type are alike."""
    return F.transform(tokens, lambda x: F.xxhash64(F.when(x.startswith("\x01"), F.substring(x, 1, 2)).otherwise(x)))


_SLOTS = [f"xxhash64('\x01{k}')" for k in "ndu"]


def _windows(hashes: str, window: int, literals: int) -> Column:
    """(pos, window hash) of the windows with enough literal tokens."""
    slots = ", ".join(_SLOTS)
    enough = f"size(filter(slice({hashes}, i + 1, {window}), h -> h not in ({slots}))) >= {literals}"
    all_ = (f"transform(if(size({hashes}) < {window}, array(), sequence(0, size({hashes}) - {window})), "
            f"i -> struct(i as pos, xxhash64(slice({hashes}, i + 1, {window})) as window))")
    has_slots = f"exists({hashes}, h -> h in ({slots}))"
    checked = f"filter({all_}, w -> transform(array(w.pos), i -> {enough})[0])"
    return F.expr(f"if({has_slots}, {checked}, {all_})")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
               item_text: str = "text", window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, at, slots, changed) per leaked item of a document.

    ``windows`` of the item's ``item_windows`` are found on the best diagonal, which begins at
    token ``at`` of the document; ``slots`` placeholder values stand against each other and
    ``changed`` of them differ. Of equal diagonals the first counts. Items shorter than a
    window, and items of which no window has enough literals, are found only as they are: one
    window stands for the whole item, which is compared token by token with its values.
    Items of fewer than ``SHORTEST`` tokens, null and empty texts match nothing. Repeated rows
    of a document or item count once; ids may be null. Every window of every document is
    looked at.
    """
    items = benchmark.select(F.col(item).alias("item_id"), typed_tokens(F.col(item_text)).alias("item_tokens")).distinct()
    items = materialize(items.withColumn("h", template(F.col("item_tokens"))))
    wanted = items.select("item_id", F.xxhash64("item_tokens").alias("version"), F.inline(_windows("h", window, literals)).alias("ipos", "window"))
    wanted = materialize(wanted)
    sizes = wanted.groupBy(F.col("item_id").alias("i"), F.col("version").alias("v")).agg(F.count("*").alias("item_windows"))

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    entries = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), template(typed_tokens(F.col("text"))).alias("h"))
    entries = entries.select("doc_id", "text_hash", F.inline(_windows("h", window, literals)))
    met = entries.join(wanted, "window").withColumn("at", F.col("pos") - F.col("ipos"))
    diagonals = met.groupBy("doc_id", "text_hash", "item_id", "version", "at").agg(
        F.countDistinct("ipos").alias("windows"), F.min("ipos").alias("lo"), F.max("ipos").alias("hi"))
    long = diagonals.join(sizes, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v"))).drop("i", "v").where(
        F.col("windows") >= coverage * F.col("item_windows"))
    long = materialize(long)

    # the few texts concerned once more, for the values in their placeholders
    texts = rows.withColumn("text_hash", F.xxhash64("text"))
    hits = long.withColumnsRenamed({"doc_id": "d", "text_hash": "t"})
    found = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).drop("d", "t")
    found = found.dropDuplicates(["doc_id", "text_hash", "item_id", "version", "at"])
    it = items.select(F.col("item_id").alias("i"), F.xxhash64("item_tokens").alias("v"), "item_tokens")
    found = found.join(it, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")))
    span = F.col("hi") - F.col("lo") + window
    ours = F.slice("item_tokens", F.col("lo") + 1, span)
    theirs = F.slice(typed_tokens(F.col("text")), F.col("at") + F.col("lo") + 1, span)
    pairs = F.filter(F.arrays_zip(ours.alias("a"), theirs.alias("b")), lambda p: p["a"].startswith("\x01") & p["b"].startswith("\x01"))
    found = found.withColumn("pairs", pairs).withColumn("kinds", F.array_distinct("pairs"))
    found = found.where(F.size("kinds") == F.size(F.array_distinct(F.transform("kinds", lambda p: p["a"]))))
    fields = ["doc_id", "item_id", "windows", "at", "item_windows", "slots", "changed"]
    found = found.withColumn("slots", F.size("pairs")).withColumn(
        "changed", F.size(F.filter("pairs", lambda p: p["a"] != p["b"]))).select(*fields)
    whole = _whole_items(texts, items, sizes, window)
    found = found if whole is None else found.unionByName(whole.select(*fields))
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct(
        (-F.col("windows")).alias("w"), "at", "item_windows", "slots", "changed")).alias("r"))
    return best.select("doc_id", "item_id", (-F.col("r.w")).alias("windows"), "r.item_windows", "r.at", "r.slots", "r.changed")


def _whole_items(texts: DataFrame, items: DataFrame, sizes: DataFrame, window: int) -> DataFrame | None:
    """Places where an item without windows of its own stands as it is; None if all items have windows."""
    known = sizes.select("i", "v")
    short = items.select("item_id", F.xxhash64("item_tokens").alias("version"), "item_tokens").join(
        known, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("version") == F.col("v")), "left_anti").where(F.size("item_tokens") >= SHORTEST)
    first = F.slice("item_tokens", F.lit(1), F.least(F.size("item_tokens"), F.lit(window)))
    short = materialize(short.select("item_id", "item_tokens", F.size(first).alias("n"), F.xxhash64(first).alias("window")))
    lengths = [r.n for r in short.select("n").distinct().collect()]  # from the shortest to a window
    if not lengths:
        return None
    tokens = texts.select("doc_id", "text_hash", typed_tokens(F.col("text")).alias("tokens"))
    runs = F.concat(*[F.expr(
        f"transform(if(size(tokens) < {n}, array(), sequence(0, size(tokens) - {n})), i -> struct({n} as n, i as at, xxhash64(slice(tokens, i + 1, {n})) as window))")
        for n in sorted(lengths)])
    met = tokens.select("doc_id", "text_hash", F.inline(runs)).join(short, ["n", "window"]).distinct()
    met = materialize(met.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}))
    again = tokens.dropDuplicates(["doc_id", "text_hash"]).join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")))
    same = F.slice("tokens", F.col("at") + 1, F.size("item_tokens")) == F.col("item_tokens")
    one = F.lit(1).cast("bigint")
    return again.where(same).select(
        "doc_id", "item_id", one.alias("windows"), one.alias("item_windows"), "at",
        F.size(F.filter("item_tokens", lambda x: x.startswith("\x01"))).alias("slots"), F.lit(0).alias("changed"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    leaks = materialize(find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak")).distinct())
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak"]), "left_anti")

"""Language identification by compression: the language whose dictionary packs a text smallest.

Every language has a zstandard raw-content dictionary, a bounded sample of its labelled
texts. A text is lower-cased, cut into blocks of fixed size, and each block compressed with
every dictionary; the language with the fewest bytes over the whole text wins. The decision is
rejected when the margin to the second is narrow.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_of_id, small_batches, table

#: The sample that a dictionary is made of: at most so many different texts of a language,
#: and so many leading characters of each. Only the dictionaries are bounded; prediction
#: reads whole texts.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 1024
BLOCK_BYTES = 16 << 10
#: Lazy matching from four bytes on: word pieces of a language are that short.
COMPRESSION = {"window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 3, "min_match": 4, "target_length": 8}
#: Narrow: a lead of less than this share of the best size, or of less than two bytes.
MIN_MARGIN = 0.002
UNDETERMINED = "und"

RESULT = "lang_pred string, score double, margin double, accepted boolean"


def fit_dictionaries(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """One raw-content dictionary per language from at most ``sample_texts`` different texts.

    The texts with the smallest hashes are taken, so copies count once and the choice
    repeats. Rows with a null text or language teach nothing; without any, the result is
    empty. Repeated rows and further columns do not matter.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        "t is not null and l is not null and t rlike '\\\\p{L}'")
    distinct = rows.groupBy("l", F.xxhash64("t").alias("h")).agg(F.min("k").alias("k"))
    # the smallest of each of 64 parts first, so that a language with most rows is no hot key
    for part in (["l", F.pmod("h", F.lit(64))], ["l"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("h"))
        distinct = distinct.withColumn("r", rank).where(F.col("r") <= sample_texts).drop("r")
    chosen = distinct.select("k")
    keys = [r.k for r in chosen.collect() if r.k is not None]
    picked = (
        rows.where(F.col("k").isin(keys)).select("l", F.xxhash64("t").alias("h"), F.substring("t", 1, sample_chars).alias("t"))
        .groupBy("l", "h").agg(F.min("t").alias("t")).orderBy("l", "h").collect()
    ) if keys else []
    found: dict[str, list[str]] = {}
    for r in picked:
        found.setdefault(r.l, []).append(r.t)
    return {k: "\n".join(v).lower().encode() for k, v in found.items()}


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    params = z.ZstdCompressionParameters(
        **COMPRESSION, strategy=z.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
    out = []
    for _, content in dictionaries:
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress)
    return out


def classify(text: str | None, names: list[str], compressors: list, block: int, min_margin: float):
    """(language, score, margin, accepted) of one text."""
    if not names or not text or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, 0.0, False
    data = text.lower().encode("utf-8", "replace")
    blocks = [data[i:i + block] for i in range(0, len(data), block)]
    sizes = [sum(len(c(b)) for b in blocks) for c in compressors]
    order = sorted(range(len(names)), key=lambda i: (sizes[i], names[i]))
    best = sizes[order[0]]
    score = 1.0 / sum(2.0 ** -min(1000, s - best) for s in sizes)
    lead = sizes[order[1]] - best if len(order) > 1 else best
    return names[order[0]], score, lead / best, lead >= max(2, min_margin * best)


def identify(
    spark: SparkSession, dictionaries: dict[str, bytes], text: Column,
    block: int = BLOCK_BYTES, min_margin: float = MIN_MARGIN,
) -> Column:
    """Struct (lang_pred, score, margin, accepted) of a text column.

    ``score`` is the share of the winner when sizes are read as code lengths; ``margin``
    the lead over the second as a share of the best size. Null, empty and letterless
    texts are ``und`` and not accepted; of equal sizes the first name in order wins and
    is not accepted. Texts of any length are read whole.
    """
    fixed = tuple(sorted(dictionaries.items()))
    shared = spark.sparkContext.broadcast(fixed)

    @F.pandas_udf(RESULT)
    def judge(texts: pd.Series) -> pd.DataFrame:
        have = shared.value
        names, compressors = [k for k, _ in have], _compressors(have)
        return pd.DataFrame(
            [classify(t, names, compressors, block, min_margin) for t in texts],
            columns=["lang_pred", "score", "margin", "accepted"],
        )

    return judge(text)


def held_out(key: str = "doc_id") -> Column:
    return crc_of_id(key) % 4 == 2


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit_dictionaries(docs.where(~held_out()))
    judged = docs.select("doc_id", held_out().alias("held_out"), identify(spark, dictionaries, F.col("text")).alias("j"))
    return judged.select("doc_id", "held_out", "j.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is rejected go; columns stay as they are."""
    small_batches(spark)
    dictionaries = fit_dictionaries(docs.where(~held_out()))
    name = "__judged"
    while name in docs.columns:
        name += "_"
    judged = docs.withColumn(name, identify(spark, dictionaries, F.col("text")))
    return judged.where(F.col(name)["accepted"]).drop(name)

from pyspark.sql import functions as F

from statedit.llm import language_id as L

WORDS = {"aa": "kal mor tin sel vak", "bb": "zuu bop wex yim cha"}


def corpus(spark):
    rows = []
    for lang, words in WORDS.items():
        w = words.split()
        for i in range(20):
            rows.append((i + 100 * (lang == "bb"), " ".join(w[(i * 7 + j * j) % 5] for j in range(40)), lang, "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def judge(spark, docs, dictionaries):
    return docs.withColumn("j", L.identify(spark, dictionaries, F.col("text")))


def test_accuracy_and_rejection(spark):
    docs = corpus(spark)
    d = L.fit_dictionaries(docs.where(~L.held_out()))
    assert sorted(d) == ["aa", "bb"]
    got = judge(spark, docs, d).where(L.held_out()).select("lang", "j.*").collect()
    assert got and all(r.lang == r.lang_pred and r.accepted and 0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "q"), (5, "kal mor " * 60_000)], "doc_id long, text string")
    rows = {r.doc_id: r.j for r in judge(spark, odd, d).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and not any(rows[i].accepted for i in (1, 2, 3, 4))
    assert rows[4].lang_pred in WORDS and rows[5].lang_pred == "aa" and rows[5].accepted


def test_nothing_to_learn_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit_dictionaries(empty) == {} and judge(spark, empty, {}).count() == 0
    unlabelled = spark.createDataFrame([(1, "kal", None), (None, None, "aa")], empty.schema)
    assert L.fit_dictionaries(unlabelled) == {}
    assert {r.j.lang_pred for r in judge(spark, unlabelled, {}).collect()} == {"und"}
    docs = corpus(spark)
    assert L.fit_dictionaries(docs) == L.fit_dictionaries(docs.union(docs))


def test_sample_is_bounded(spark):
    d = L.fit_dictionaries(corpus(spark), sample_texts=3, sample_chars=50)
    assert all(0 < len(x) <= 3 * 51 for x in d.values())


def test_equals_plain_one_shot_compression(spark):
    """The same choice from a fresh compressor per block and dictionary, written out in full."""
    import zstandard as z

    docs = corpus(spark)
    d = L.fit_dictionaries(docs.where(~L.held_out()))
    params = z.ZstdCompressionParameters(**L.COMPRESSION, strategy=z.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)

    def size(text, content):
        data, total = text.lower().encode(), 0
        for i in range(0, len(data), L.BLOCK_BYTES):
            own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            total += len(z.ZstdCompressor(dict_data=own, compression_params=params).compress(data[i:i + L.BLOCK_BYTES]))
        return total

    mixed = [(500 + i, a * 3 + b * i * 400) for i, (a, b) in enumerate([("kal mor tin ", "zuu bop wex "), ("yim cha ", "sel vak mor "), ("Æ kal ", "zuu ")])]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(mixed, "doc_id long, text string"))
    for r in judge(spark, df, d).collect():
        sizes = sorted((size(r.text, c), name) for name, c in d.items())
        lead = sizes[1][0] - sizes[0][0]
        assert r.j.lang_pred == sizes[0][1] and r.j.accepted == (lead >= max(2, L.MIN_MARGIN * sizes[0][0]))
        assert abs(r.j.margin - lead / sizes[0][0]) < 1e-12


def test_stage_keeps_a_clashing_column(spark):
    docs = corpus(spark).selectExpr("*", "1 AS __judged")
    assert L.stage(spark, docs, "").columns == docs.columns


def test_stage_keeps_columns_and_clean_documents(spark):
    docs = corpus(spark).unionByName(spark.createDataFrame([(900, "???", "aa", "y")], corpus(spark).schema))
    kept = L.stage(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {900}

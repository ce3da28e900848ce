"""The pipeline against its stages written out plainly."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from statedit.llm import language_id, ngram_join, packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus():
    rng = random.Random(11)
    words = {k: ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(90)] for k, letters in (("aa", "abcdeimn"), ("bb", "oprstuvk"))}
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        rows.append([i, " ".join(rng.choices(words[lang], k=rng.choice([30, 80, 200]))) + ".", lang])
    items = [(k, " ".join(rng.choices(words["aa"], k=14))) for k in range(3)]
    for k, (_, text) in enumerate(items):  # leaks
        rows.append([100 + k, f"{rows[2 * k][1]} {text} {rows[2 * k + 2][1]}", "aa"])
    for k in range(6):  # an exact copy, near copies and a far one
        w = rows[k][1].split()
        for j in range(0, len(w), 400 if k % 3 else 7):
            w[j] = w[j] + "x" * (k > 1)
        rows.append([200 + k, " ".join(w), rows[k][2]])
    return [tuple(r) for r in rows] + [(300, "??? 12", "aa"), (301, None, "bb"), (302, "", None)], items


def test_whole_pipeline(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # language: the smallest of the compressed sizes, by a clear margin
    d = language_id.fit_dictionaries(docs.where(~language_id.held_out()))
    fixed = tuple(sorted(d.items()))
    judge = language_id._compressors(fixed)
    kept = [(k, t) for k, t, _ in rows if language_id.classify(t, [n for n, _ in fixed], judge, language_id.BLOCK_BYTES, language_id.MIN_MARGIN)[3]]
    assert 300 not in dict(kept) and 301 not in dict(kept) and len(kept) > 60
    # one of each component of linked documents
    sets, label = {k: shingles(t) for k, t in kept}, {k: k for k, _ in kept}
    for _ in kept:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    kept = [(k, t) for k, t in kept if label[k] == k]
    assert 200 not in dict(kept)
    # no benchmark items
    kept = [(k, t) for k, t in kept if not any(text.lower() in t.lower() for _, text in items)]
    assert not {100, 101, 102} & set(dict(kept))
    # every token of every document left lies in one piece, sequences are gapless and end full or at a power of two
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in kept}
    assert {r.doc_id for r in got} == set(ids)
    for k, own in ids.items():
        at = 0
        for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own)
            assert r.ids_crc32 == zlib.crc32(np.array(own[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    for s in {r.sequence_id for r in got}:
        pieces = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        ends = np.cumsum([n for _, n in pieces])
        assert [o for o, _ in pieces] == [0, *ends[:-1]] and ends[-1] <= packing.SIZE


def test_every_stage_returns_documents(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(k, t, lang, "s", 1) for k, t, lang in rows[:30]], "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert ngram_join.stage(spark, docs.union(docs), str(tmp_path)).count() == ngram_join.stage(spark, docs, str(tmp_path)).count()


@pytest.mark.parametrize("stage", [language_id.stage, ngram_join.stage, packing.stage])
def test_stages_hand_few_rows_at_once_to_python(spark, stage):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(1, "a b c", "aa", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for before, after in ((10_000, 1000),):
        spark.conf.set(name, before)
        try:
            stage(spark, docs, "")
            assert int(spark.conf.get(name)) == after
        finally:
            spark.conf.unset(name)

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from statedit.llm import packing as P


def check(rows, texts, size):
    """Pieces rebuild every document and sequence; returns the padding."""
    t = Tokenizer.from_file(P.vocabulary())
    want = {k: [*t.encode(v or "", add_special_tokens=False).ids, 2] for k, v in texts.items()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == r.length
        assert r.doc_tokens == len(want[r.doc_id])
    assert set(docs) == set(want)
    for k, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        assert list(itertools.chain(*(r.ids for r in pieces))) == want[k]
        assert [r.start for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1]
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *itertools.accumulate(r.length for r in pieces)][:-1] and n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding, sum(map(len, want.values()))


def test_round_trip(spark):
    rng = random.Random(3)
    texts = {1: None, 2: "", 3: " \n\t ", 4: "It's 42! <|endoftext|> É x y é ΣΑΣ. Fin", 5: "no end " * 3000}
    texts |= {i: ". ".join("".join(rng.choices("abcdef ", k=rng.randint(1, 90))) for _ in range(rng.randint(1, 30))) for i in range(6, 150)}
    docs = spark.createDataFrame([(v, k, "c") for k, v in texts.items()], "text string, doc_id long, start string").coalesce(2)
    for size, block in ((64, 700), (256, 1 << 19), (100, 1000)):
        padding, total = check(P.pack(docs, P.vocabulary(), size, block_tokens=block).collect(), texts, size)
        assert padding <= (0.1 if size == 256 else 0.3) * total + 2 * size


def test_empty_repeats_and_null_id(spark):
    schema = "doc_id long, text string"
    assert P.pack(spark.createDataFrame([], schema), P.vocabulary()).count() == 0
    rows = P.pack(spark.createDataFrame([(None, "a b"), (7, "x"), (7, "x")], schema), P.vocabulary()).collect()
    assert sorted(str(r.doc_id) for r in rows if r.start == 0) == ["7", "7", "None"]


def cost(pos, pen, cuts, size):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        n = int(pos[b] - pos[a])
        if n > size:
            return float("inf")
        total += min(size - n, P.SHORT if n & (n - 1) == 0 else size) + int(pen[b])
    return total


def test_cut_is_optimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 11))
        pos = np.concatenate(([0], np.cumsum(rng.integers(1, 15, n - 1))))
        pen = rng.choice([0, 3, 9], n)
        best = min(cost(pos, pen, (0, *c, n - 1), 16) for k in range(n) for c in itertools.combinations(range(1, n - 1), k))
        assert cost(pos, pen, P.cut(pos, pen, 16), 16) == best


def test_word_cache_equals_the_tokenizer():
    rng = random.Random(9)
    t = Tokenizer.from_file(P.vocabulary())
    pool = ["It's.", "don't!?", "é.", "—.", "x_.", "a\x1cb", "²,", "Ⅷ.", "Á.", "<|endoftext|>.", " y,", "İ.", "...", "w!.", "ab,cd.", "a.'s ", "q'.", "Σ.", " ", "12.5%"]
    words = P.WordIds(P.vocabulary())
    for _ in range(300):
        text = "".join(rng.choice(pool) + rng.choice([" ", "\n", "\x0b ", ""]) for _ in range(rng.randint(1, 12)))
        assert words.encode(text.encode())[0].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_words_of_many_texts_are_learned_together(monkeypatch):
    """Texts of a group ask the tokenizer once, and Latin letters of any kind get its ids."""
    t = Tokenizer.from_file(P.vocabulary())
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(["", ".", "!?"]) for _ in range(40)) for _ in range(60)]
    texts += ["", "  ", "<|endoftext|> ÀÉ Çé"]
    words, asked = P.WordIds(P.vocabulary()), []
    learn = words._learn
    monkeypatch.setattr(words, "_learn", lambda new: (asked.append(len(new)), learn(new)))
    got = list(words.encode_all([x.encode() for x in texts]))
    assert len(asked) == 1
    for text, (ids, ends) in zip(texts, got):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text
    one = P.WordIds(P.vocabulary())
    assert all(np.array_equal(a, b) for text, pair in zip(texts, got) for a, b in zip(pair, one.encode(text.encode())))
    small = P.WordIds(P.vocabulary(), cache_words=50)  # forgets words between the groups
    monkeypatch.setattr(P, "GROUP_BYTES", 1)
    assert all(np.array_equal(a, b) for x, y in zip(got, small.encode_all([x.encode() for x in texts])) for a, b in zip(x, y))

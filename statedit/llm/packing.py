"""Packing documents into token sequences by order-preserving dynamic programming.

Every task packs the stream of its own rows in their order, so nothing is shuffled. Cuts
between windows fall on document or sentence ends (an overlong sentence is cut at fixed
steps). The program minimises padding plus penalties for documents that are cut:

    f(j) = penalty(j) + min over i with pos(j) - pos(i) <= size of f(i) + size - (pos(j) - pos(i))

where the minimum over the sliding range of i is kept by a monotone queue of f(i) + pos(i).
A window whose length is a power of two has no padding; these transitions are looked up
next to the queue. Memory is bounded: the stream is solved in blocks, and the last windows
of a block are opened again with the next one.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, texts_of

SIZE = 4096
END_ID = 2
#: Cost of a cut in tokens of padding: between sentences, inside a sentence, and of a short sequence.
SENTENCE_CUT, HARD_CUT, SHORT = 16, 64, 16
#: Tokens after which a block is solved, and the step of cuts inside an overlong sentence.
BLOCK_TOKENS, HARD_STEP = 1 << 19, 256
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 1_000_000
#: The same for a worker that earlier stages of a pipeline have left little memory.
STAGE_CACHE_WORDS = 250_000
#: Marks at the end of a word; the tokenizer always parts them from a letter or digit. (Not so
#: behind U+0130, whose lower case ends in a combining mark.)
MARKS = ".,;:!?*#%&$|"
#: Bytes of texts whose words are looked up together.
GROUP_BYTES = 1 << 20
#: Lower-case Latin letters beyond ASCII as the tokenizer's model has them: a letter for each byte of UTF-8, by GPT-2's table.
NOT_ASCII = re.compile("[^\0-\x7f]")
_BYTES = {b: chr(256 + i) for i, b in enumerate((*range(0x21), *range(0x7F, 0xA1), 0xAD))}
BYTE_LETTERS = {chr(c): "".join(_BYTES.get(b, chr(b)) for b in chr(c).encode()) for c in range(0x80, 0x3000)}

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids array<int>")


class WordIds:
    """Token ids of white-space separated words, each encoded once.

    The tokenizer never joins across white space, so the ids of a text are those of its
    words one after another.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # the same model behind a split at spaces, for words that the file's rules leave whole; kept only if it agrees
        self.latin = None
        self.clear()
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130"]
        probe = ["".join(letters[i:i + n]).lower() for n in (1, 2, 5) for i in range(len(letters))]
        if self.word_end.any():
            want = self._encode_latin(probe)
            self.latin = Tokenizer(self.tokenizer.model)
            self.latin.pre_tokenizer = WhitespaceSplit()
            if want is None or self._encode_latin(probe) != want:
                self.latin = None

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.parts: dict[str, bytes] = {"": b""}
        self.used = self.tokens = 0
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts, self.lens = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ends = np.zeros(1 << 14, bool)

    def _encode_latin(self, words: list[str]) -> list[bytes] | None:
        """Packed ids of words of Latin letters, which go through as one text: the last token of each ends it."""
        text = " ".join(words)
        if self.latin is not None:
            text = text.lower()
            if not text.isascii():
                text = NOT_ASCII.sub(lambda m: BYTE_LETTERS[m[0]], text)
            words_of = text.split(" ")
            texts = [" ".join(words_of[i:i + 64]) for i in range(0, len(words_of), 64)]
            ids = [x for c in self.latin.encode_batch_fast(texts, add_special_tokens=False) for x in c.ids]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        ids = np.array(ids, np.int32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            return None
        packed, cut = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [packed[i:j] for i, j in zip(cut, cut[1:])]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word."""
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) < "\u0250" and "\u0130" not in w)]
        known = self._encode_latin(plain) if plain and self.word_end.any() else None
        out = dict(zip(plain, known)) if known else {}
        rest = [w for w in words if w not in out]
        for w, c in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            out[w] = np.array(c.ids, np.int32).tobytes()
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words; marks behind a letter or digit are a token run of their own."""
        cores = b" ".join(words).decode("utf-8", "replace").split(" ")
        marks = [""] * len(cores)
        for i, text in enumerate(cores):
            if text[-1] in MARKS:
                core = text.rstrip(MARKS)
                if core[-1:].isalnum() and core[-1] != "\u0130":
                    cores[i], marks[i] = core, text[len(core):]
        parts = self.parts
        parts.update(self._encode_words(list({*cores, *marks}.difference(parts))))
        packed = [parts[core] + parts[tail] if tail else parts[core] for core, tail in zip(cores, marks)]
        ids = np.frombuffer(b"".join(packed), np.int32)
        lens = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        n, tokens = self.used + len(words), self.tokens + len(ids)
        while tokens > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while n > len(self.lens):
            self.starts, self.lens, self.ends = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens, self.ends))
        self.flat[self.tokens:tokens] = ids
        self.starts[self.used:n] = self.tokens + np.cumsum(lens) - lens
        self.lens[self.used:n] = lens
        self.ends[self.used:n] = [w.rstrip(b"\"')]").endswith((b".", b"!", b"?")) for w in words]
        self.at.update(zip(words, range(self.used, n)))
        self.used, self.tokens = n, tokens

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word; each different one is looked up once."""
        codes = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))  # codes ascend by first occurrence
        distinct = [words[i] for i in first.tolist()]
        get = self.at.get
        found = np.array([get(w, -1) for w in distinct])
        if (found < 0).any() and self.used > self.cache_words:
            self.clear()
            found[:] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            self._learn([distinct[i] for i in new.tolist()])
            found[new] = np.arange(self.used - len(new), self.used)
        return found[codes]

    def encode_all(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids, and the positions behind its sentence ends. Words of several texts are looked up together."""
        at = 0
        while at < len(texts):
            words, counts, size = [], [], 0
            while at < len(texts) and (not counts or size + len(texts[at]) <= GROUP_BYTES):
                text = texts[at]
                own = (text if b"<|" in text else text.lower()).split()  # names of special tokens have their case
                words += own
                counts.append(len(own))
                size += len(text)
                at += 1
            if not words:
                yield from ((np.zeros(0, np.int32), np.zeros(0, np.int64)) for _ in counts)
                continue
            k = self._numbers(words)
            lens = self.lens[k]
            behind = np.cumsum(lens)
            source = np.repeat(self.starts[k] - behind + lens, lens) + np.arange(behind[-1])
            ids, ends = self.flat[source], self.ends[k]
            stops = np.cumsum(counts)
            cuts = np.concatenate(([0], behind))[np.concatenate(([0], stops))].tolist()
            for i, j, low, high in zip([0, *stops.tolist()], stops.tolist(), cuts, cuts[1:]):
                yield ids[low:high], behind[i:j][ends[i:j]] - low

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text, and the positions behind its sentence ends."""
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def word_ids(path: str, cache_words: int = CACHE_WORDS) -> WordIds:
    return WordIds(path, cache_words)


def cut(pos: np.ndarray, pen: np.ndarray, size: int) -> list[int]:
    """Indices of the best cuts, first and last boundary included.

    ``pos`` are ascending boundary positions, no two neighbours further apart than
    ``size``; ``pen`` the cost of cutting there. Of equal costs the longer window wins.
    """
    n = len(pos)
    ends, froms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    power = 1
    while power < size:
        i = np.searchsorted(pos, pos - power)
        hit = np.flatnonzero((pos[np.minimum(i, n - 1)] == pos - power) & (pos - power >= pos[0]))
        ends.append(hit)
        froms.append(i[hit])
        power *= 2
    ends = np.concatenate(ends)
    order = np.argsort(ends, kind="stable")
    ends, froms = [*ends[order].tolist(), n], np.concatenate(froms)[order].tolist()
    at = 0
    p, pen = pos.tolist(), pen.tolist()
    f, back, g = [0.0] * n, [0] * n, [0.0] * n
    g[0] = p[0]
    queue = deque((0,))
    for j in range(1, n):
        x = p[j]
        low = x - size
        while p[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        best = g[i] + size - x
        while ends[at] == j:
            k = froms[at]
            at += 1
            other = f[k] + SHORT
            if other < best:
                best, i = other, k
        best += pen[j]
        f[j], back[j] = best, i
        y = best + x
        g[j] = y
        while queue and g[queue[-1]] > y:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


class Packer:
    """The open end of one task's stream: its ids, boundaries and documents."""

    def __init__(self, size: int, first_sequence: int, with_ids: bool):
        self.size, self.sequence, self.with_ids = size, first_sequence, with_ids
        self.base = 0
        self.ids: list[np.ndarray] = []
        self.tokens = 0
        self.bounds: list[np.ndarray] = []
        self.pens: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # id, first position, tokens

    def add(self, doc_id, ids: np.ndarray, sentences: np.ndarray) -> None:
        start, n = self.base + self.tokens, len(ids) + 1
        self.docs.append((doc_id, start, n))
        self.ids += [ids, np.array([END_ID], np.int32)]
        inner = sentences[(sentences > 0) & (sentences < n)]
        marks = np.concatenate(([0], inner, [n]))
        gaps = np.diff(marks)
        pen = np.full(len(inner) + 1, SENTENCE_CUT)
        pen[-1] = 0
        inner = np.concatenate((inner, [n]))
        step = min(HARD_STEP, self.size)
        if (gaps > step).any():
            hard = np.concatenate([np.arange(a + step, a + g, step) for a, g in zip(marks[:-1][gaps > step], gaps[gaps > step])])
            inner, pen = np.concatenate((inner, hard)), np.concatenate((pen, np.full(len(hard), HARD_CUT)))
            order = np.argsort(inner, kind="stable")
            inner, pen = inner[order], pen[order]
        keep = np.concatenate((np.diff(inner) > 0, [True]))
        self.bounds.append(inner[keep] + start)
        self.pens.append(pen[keep])
        self.tokens += n

    def flush(self, last: bool) -> Iterator[tuple]:
        """Solve what is open; without ``last``, the two final windows stay open."""
        if not self.tokens:
            return
        pos = np.concatenate([np.array([self.base]), *self.bounds])
        pen = np.concatenate([np.array([0]), *self.pens])
        end = self.base + self.tokens
        if last:  # the rest may be cut anywhere, so that it can fill powers of two
            tail = np.setdiff1d(np.arange(max(self.base + 1, end - self.size), end), pos)
            pos, pen = np.concatenate((pos, tail)), np.concatenate((pen, np.full(len(tail), HARD_CUT)))
            order = np.argsort(pos, kind="stable")
            pos, pen = pos[order], pen[order]
        cuts = pos[cut(pos, pen, self.size)]
        if not last:
            cuts = cuts[:-2]
            if len(cuts) < 2:
                return
        ids = np.concatenate(self.ids)
        yield from self._pieces(cuts, ids)
        done = int(cuts[-1])
        self.ids = [ids[done - self.base:].copy()]
        keep = pos > done
        self.bounds, self.pens = [pos[keep]], [pen[keep]]
        self.docs = [d for d in self.docs if d[1] + d[2] > done]
        self.tokens -= done - self.base
        self.base = done

    def _pieces(self, cuts: np.ndarray, ids: np.ndarray) -> Iterator[tuple]:
        starts = np.array([d[1] for d in self.docs])
        inside = starts[(starts > cuts[0]) & (starts < cuts[-1])]
        edges = np.union1d(cuts, inside)
        doc = np.searchsorted(starts, edges[:-1], side="right") - 1
        window = np.searchsorted(cuts, edges[:-1], side="right") - 1
        raw = ids.astype("<u4")
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), window.tolist()):
            doc_id, first, n = self.docs[d]
            piece = raw[a - self.base:b - self.base]
            yield (doc_id, a - first, b - a, zlib.crc32(piece), n, self.sequence + w, a - int(cuts[w]),
                   piece.astype(np.int32) if self.with_ids else None)
        self.sequence += len(cuts) - 1


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, key: str = "doc_id", text: str = "text",
         block_tokens: int = BLOCK_TOKENS, with_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece of a document in a sequence of at most ``size`` tokens.

    Documents keep the order of the input within a task; every task has its own sequences,
    numbered from its partition. A null or empty text is the end token alone; a null id
    stays null; repeated rows are packed as often as they occur; an empty input gives no
    rows. Only ``key`` and ``text`` are read. With ``with_ids`` the token ids come along.
    ``cache_words`` bounds the words whose ids a worker remembers; it changes no result.
    """
    types = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
             ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, cache_words)
        packer = Packer(size, TaskContext.get().partitionId() << 33, with_ids)

        def rows(pieces):
            out = list(pieces)
            for i in range(0, len(out), 1 << 14):
                columns = zip(*out[i:i + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                for doc_id, coded in zip(ids[at:at + 256], words.encode_all(texts_of(texts.slice(at, 256)))):
                    packer.add(doc_id, *coded)
                    if packer.tokens >= block_tokens:
                        yield from rows(packer.flush(False))
        yield from rows(packer.flush(True))

    packed = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
    return packed if with_ids else packed.drop("ids")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the sequences."""
    small_batches(spark)
    return pack(docs, vocabulary(), with_ids=False, cache_words=STAGE_CACHE_WORDS)

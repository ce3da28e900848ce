"""Exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

The library merges, in the whole text, the neighbours whose union is the best piece, until no
union is a piece. The same result follows from left to right: a sequence of pieces is the
encoding exactly if every two neighbours, merged again from single characters, come out as
these two. An Aho-Corasick automaton gives the longest piece that starts at a position; if
it does not go with the piece before, the next shorter prefix is tried, and if none does,
the last piece is taken back. A bit field of failed positions keeps a position from being
tried twice, so the work is linear in the text.

Where two neighbouring characters stand together in no piece, no piece spans them. Spaces
behind a word and marks behind a letter are such places, so a text falls into segments that
are encoded on their own, and frequent ones once. Which marks part a text is read from the
model's pieces.
"""

from __future__ import annotations

import codecs
import re
import sys
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Segments (twice as many, with those of before) and pairs of neighbours a worker remembers, and the longest such segment.
CACHE_SEGMENTS, CACHE_PAIRS, CACHE_CHARS = 300_000, 300_000, 48
#: Rows and characters that are encoded before they are handed on.
ROWS, CHARS = 512, 1 << 22

codecs.register_error("statedit_each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Vocabulary of a merge-type model: white space is a piece mark, unknown characters are bytes.

    Text is not normalised but for one space put in front (the models' settings).
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte, control, unknown = ([f(i) for i in range(n)] for f in (sp.is_byte, sp.is_control, sp.is_unknown))
        self.ids = {p: i for i, p in enumerate(pieces) if not (byte[i] or control[i] or unknown[i] or sp.is_unused(i))}
        self.packed = {p: i.to_bytes(4, sys.byteorder) for p, i in self.ids.items()}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if byte[i]}
        self.unknown_id = sp.unk_id()
        self.end_id = sp.eos_id()
        self.bytes_of = [
            b"" if control[i] else b" \xe2\x81\x87 " if unknown[i] else bytes([int(pieces[i][3:5], 16)]) if byte[i]
            else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.control = {i for i in range(n) if control[i]}
        self.leads = [p[:1] == SPACE and p in self.ids for p in pieces]
        self.segments = self._segments()

        # a piece that is not its own encoding never comes out
        self.reachable = {p for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p in self.reachable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.shorter = {p: self._longest_prefix(p[:-1]) for p in self.reachable if len(p) > 1}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _segments(self):
        """A function that cuts a text in front of spaces and of marks, where no piece spans the cut.

        Marks are closed: what stands in front of a mark in a piece is a mark itself. So a mark
        may be cut off from all but marks and spaces, and a space from all but spaces.
        """
        inner = {(a, b) for p in self.ids for a, b in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in inner):
            return lambda text: [text]
        marks = {chr(c) for c in range(128) if not chr(c).isalpha()}
        while more := {a for a, b in inner if b in marks} - marks - {SPACE}:
            marks |= more
        k = "".join(re.escape(c) for c in sorted(marks))
        return re.compile(f"{SPACE}+[{k}]*[^{SPACE}{k}]*|[{k}]+[^{SPACE}{k}]*|[^{SPACE}{k}]+").findall

    def _longest_prefix(self, text: str) -> int:
        return next((k for k in range(len(text), 1, -1) if text[:k] in self.reachable), 1)

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by the definition: the best union first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the two come out again when their text is merged."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self.merge(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """Pieces of a segment; a character without a piece stands for itself."""
        if text in self.reachable:
            return [text]
        n = len(text)
        longest = [1] * n
        for end, size in self.automaton.iter(text):
            longest[end - size + 1] = size  # ends ascend: the longest comes last
        alive = bytearray(b"\x01") * (n + 1)
        out: list[str] = []
        known, shorter = self.pairs.get, self.shorter
        at, size, last = 0, longest[0], None
        while at < n:
            piece = text[at:at + size]
            if alive[at + size]:
                fits = last is None or known((last, piece))
                if fits or fits is None and self.fits(last, piece):
                    out.append(piece)
                    last = piece
                    at += size
                    if at < n:
                        size = longest[at]
                    continue
            size = shorter.get(piece, 0)
            while not size:  # nothing goes on from here: take the last piece back
                alive[at] = 0
                if not out:
                    return self.merge(text)
                piece = out.pop()
                at -= len(piece)
                size = shorter.get(piece, 0)
            last = out[-1] if out else None
        return out

    def _packed(self, segment: str) -> bytes:
        parts, packed = self.split(segment), self.packed
        try:
            return b"".join([packed[p] for p in parts])
        except KeyError:
            pass
        unknown = self.unknown_id.to_bytes(4, sys.byteorder)
        out: list[bytes] = []
        for p in parts:
            if p in packed:
                out.append(packed[p])
            elif self.byte_ids:
                out.extend(self.byte_ids[b].to_bytes(4, sys.byteorder) for b in p.encode())
            elif not out or out[-1] != unknown:
                out.append(unknown)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Packed 32-bit ids of a text, without an end id."""
        if not text:
            return b""
        parts = self.segments(SPACE + text.replace(" ", SPACE))
        if len(self.cache) >= CACHE_SEGMENTS:  # the segments of late stay at hand
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        new = set(parts).difference(cache)
        for s in new:
            cache[s] = older.get(s) or self._packed(s)
        packed = b"".join([cache[s] for s in parts])
        if len(new) > CACHE_SEGMENTS:
            self.cache = {}
        else:
            for s in new:
                if len(s) > CACHE_CHARS:
                    del cache[s]
        return packed

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids: control ids are silent, a byte that is no UTF-8 becomes U+FFFD.

        The space that encoding puts in front is taken away.
        """
        ids = list(ids)
        while ids and ids[-1] in self.control:
            ids.pop()
        runs = [ids]
        if not self.control.isdisjoint(ids):  # bytes on the two sides of a control id are no one character
            runs = [[]]
            for i in ids:
                if i in self.control:
                    runs.append([])
                else:
                    runs[-1].append(i)
        texts, front = [], True
        for run in filter(None, runs):
            parts = list(map(self.bytes_of.__getitem__, run))
            if front and self.leads[run[0]]:
                parts[0] = parts[0][1:]
            front = False
            texts.append(b"".join(parts).decode("utf-8", "statedit_each_byte"))
        return "".join(texts)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _groups(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``ROWS`` rows and about ``CHARS`` units."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if i > start and (i - start >= ROWS or total + s > CHARS):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: the ids of the whole text, and an end id.

    A null text counts as empty: it has the end id alone. Repeated rows and null keys are
    encoded like any other, in place; further columns are not read.
    """

    def run(batches):
        model = piece_model(path)
        last = np.array([model.end_id], np.int32).tobytes() if end else b""
        for batch in batches:
            for part in _groups(batch, pc.binary_length(batch.column(1)).fill_null(0).to_numpy()):
                packed = [model.encode(t or "") + last for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in packed]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", as_column: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ``ids``; null and empty lists give the empty text.

    Ids outside the vocabulary fail the job. A column of the new name is replaced.
    """
    others = [c for c in encoded.columns if c != as_column]
    rows = encoded.select(*others)
    schema = rows.withColumn(as_column, F.lit("")).schema

    def run(batches):
        model = piece_model(path)
        at = others.index(ids)
        for batch in batches:
            for part in _groups(batch, pc.list_value_length(batch.column(at)).fill_null(0).to_numpy()):
                texts = [model.decode(x or ()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*others, as_column])

    return rows.mapInArrow(run, schema)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

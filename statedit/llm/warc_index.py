"""WARC archives with a two-level capture index.

Pages are sorted by reversed-host URL key over the whole table; every task writes one
archive of gzip members, in the same order index lines in compressed blocks, and the sparse
directory of these blocks: their first keys and places. The list of parts, a row per task, is
all that the driver sees. A lookup finds part and block by binary search, reads that range of
the index, and then the range of the record. Files are named by task attempt and only those
in the stored list of parts count, so a lost or repeated task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table

#: Index lines of a block.
BLOCK_LINES = 256
DATE = "2020-01-01T00:00:00Z"  # pages carry no date; a record must


def surt(url: str | None) -> str:
    """Key with the host's labels reversed: ``com,example,www)/path?query``; null is empty."""
    if not url:
        return ""
    head, found, rest = url.partition("://")
    rest = rest if found else head
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    return ",".join(reversed(host.split("."))) + ")" + path


def surt_column(url: Column) -> Column:
    """``surt`` as a column expression."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"(?s)^.*?://(.*)$", "$1")
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), r"\.")), ",")
    return F.when(text == "", "").otherwise(F.concat(host, F.lit(")"), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)))


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value) -> str:
    return "".join(" " if c in "\r\n" else c for c in str(value))


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record; a revisit has no payload, but its size, digest and the record it refers to."""
    body = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header(url or '')}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record, its body checked against its length and, of a response, its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[:int(fields["Content-Length"])]
    page = lambda name: None if fields[name][10:-1] == "None" else int(fields[name][10:-1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if first != "WARC/1.1" or rest[len(body):] != b"\r\n\r\n" or kind == "response" and sha1_base32(body) != digest:
        raise ValueError(f"Broken record of page {fields['WARC-Record-ID']}.")
    size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": page("WARC-Refers-To") if kind == "revisit" else None, "payload": body}


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _deflated(html: pd.Series) -> pd.Series:
    return html.map(lambda text: zlib.compress(text.encode(), 6))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write archives, index and directories; a row per part: (first, last, part, file, blocks, lines).

    A page's payload is its html in UTF-8, null as empty. Of equal payloads the page with
    the largest id is the response (of equal ids, one by url), the others revisit it.
    Null ids come last of all. An empty table gives no parts. Payloads are shuffled
    deflated.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    kept = materialize(rows.select("sha", "page_id", "url").groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("kept")))
    kept = kept.select("sha", F.col("kept.page_id").alias("to"), F.col("kept.url").alias("to_url"))
    deflated = rows.select("sha", "page_id", "url", F.pandas_udf(_deflated, "binary")("html").alias("body"))
    keyed = deflated.join(kept, "sha").withColumn("surt", surt_column(F.col("url")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.select("surt", "page_id", "url", "body", "to", "to_url").repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}-{uuid.uuid4().hex}"
        fs, path = _open(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        lines: list[str] = []
        found: list[tuple] = []  # (first, last, at, size, lines) of each block
        place = index_at = 0
        done = None
        with fs.open_output_stream(path + ".warc.gz", compression=None) as warc, fs.open_output_stream(path + ".cdx.gz", compression=None) as cdx:
            def close_block():
                nonlocal index_at, lines
                if lines:
                    packed = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
                    cdx.write(packed)
                    ends = [json.loads(x)[:2] for x in (lines[0], lines[-1])]
                    found.append((ends[0][0], ends[1][0], index_at, len(packed), len(lines)))
                    index_at += len(packed)
                    lines = []

            for batch in batches:
                for i in range(batch.num_rows):
                    k, page_id, link, body, to, to_url = (batch.column(c)[i].as_py() for c in range(6))
                    payload = zlib.decompress(body)
                    own = (page_id, link) == (to, to_url) and (k, page_id, link) != done
                    done = (k, page_id, link) if own else done
                    packed = gzip.compress(record(page_id, link, payload, sha1_base32(payload), "response" if own else "revisit", to), 6, mtime=0)
                    warc.write(packed)
                    lines.append(json.dumps([k, page_id, place, len(packed)]))
                    place += len(packed)
                    if len(lines) == block_lines:
                        close_block()
            close_block()
        if found:
            with fs.open_output_stream(path + ".dir", compression=None) as out:
                out.write("\n".join(map(json.dumps, found)).encode())
            row = (found[0][0], found[-1][1], task.partitionId(), name, len(found), sum(f[4] for f in found))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names=["first", "last", "part", "file", "blocks", "lines"])

    return materialize(ordered.mapInArrow(run, "first string, last string, part int, file string, blocks int, lines long"))


class Index:
    """Lookups in the parts ``(first, last, file)`` in key order; one directory and one block are held at a time."""

    def __init__(self, parts: list[tuple[str, str, str]]):
        self.parts, self.lasts = parts, [p[1] for p in parts]
        self.files: dict = {}
        self.part, self.blocks, self.ends = -1, [], []
        self.block, self.lines, self.keys = None, [], []

    def _read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) > 4:
                for f in self.files.values():
                    f.close()
                self.files.clear()
            fs, path = _open(name)
            self.files[name] = fs.open_input_file(path)
        self.files[name].seek(at)
        return self.files[name].read(size)

    def captures(self, key: str) -> Iterator[tuple[int | None, bytes]]:
        """(page id, record) of every capture of a key."""
        at = bisect_left(self.lasts, key)
        while at < len(self.parts) and self.parts[at][0] <= key:
            name = self.parts[at][2]
            if at != self.part:
                fs, path = _open(name + ".dir")
                with fs.open_input_file(path) as f:
                    self.blocks = [json.loads(x) for x in f.read().decode().split("\n")]
                self.part, self.ends = at, [b[1] for b in self.blocks]
            block = bisect_left(self.ends, key)
            while block < len(self.blocks) and self.blocks[block][0] <= key:
                if (at, block) != self.block:
                    packed = self._read(name + ".cdx.gz", *self.blocks[block][2:4])
                    self.lines = [json.loads(x) for x in gzip.decompress(packed).decode().split("\n")]
                    self.block, self.keys = (at, block), [x[0] for x in self.lines]
                for _, page_id, start, n in self.lines[bisect_left(self.keys, key):bisect_right(self.keys, key)]:
                    yield page_id, gzip.decompress(self._read(name + ".warc.gz", start, n))
                block += 1
            at += 1


def read_captures(keys: DataFrame, parts: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of every key in ``surt``, read through the index; each key should occur once.

    Keys without captures give no rows. Sorted keys read each block once.
    """
    listed = [(r.first, r.last, r.file) for r in parts.orderBy("part").collect()]  # a row per task of the writer
    names = ["surt", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    schema = "surt string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(listed)
        rows, size = [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names=names)

        for batch in batches:
            for key in batch.column(0).to_pylist():
                for _, data in index.captures(key):
                    rows.append({"surt": key, **parse(data)})
                    size += len(data) if with_payload else 200
                    if size > 4_000_000:
                        yield out()
                        rows, size = [], 0
        yield out()

    return keys.select("surt").mapInArrow(run, schema)


def write_and_read(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Archives of all pages, read back through the index by every url key."""
    parts = write_archives(pages, folder, key, url, html, block_lines)
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = pages.select(surt_column(F.col(url)).alias("surt")).distinct()
    return read_captures(keys.repartitionByRange(n, "surt").sortWithinPartitions("surt"), parts).drop("surt")


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))

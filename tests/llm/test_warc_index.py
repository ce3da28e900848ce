import base64
import gzip
import hashlib
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from statedit.llm import warc_index as X

SCHEMA = "page_id long, url string, html string, surt string, sha string"


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        url = rng.choice([None, "", "http://a.example.com/x", f"https://B{i % 7}.example.org/{i}?q=1#t", f"nohost{i}", "http://a.b/é\nc", f"http://z.b/{i}"])
        rows.append((i * 3, url, rng.choice([None, "", "<p>same</p>", f"<p>ü {i}</p>" * (i % 50)])))
    return rows + [(9999, "http://long/", "x" * 400_000)]


def expected(rows):
    by = {}
    for k, _, h in rows:
        by[h or ""] = max(by.get(h or "", -1), k)
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        own = by[h or ""] == k
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else by[h or ""]))
    return Counter(out)


def test_round_trip(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA).repartition(5)
    for lines in (3, 256):
        got = X.write_and_read(df, f"{tmp_path}/w{lines}", block_lines=lines).collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected(rows)


def test_lookup_and_members(spark, tmp_path):
    rows = corpus()
    parts = X.write_archives(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), f"{tmp_path}/w", block_lines=4)
    urls = ["http://A.example.com/x", "http://z.b/299", "http://not.there/", None]
    keys = spark.createDataFrame([(X.surt(u),) for u in urls], "surt string")
    got = X.read_captures(keys, parts, with_payload=True).collect()
    want = [r[0] for r in rows if X.surt(r[1]) in {X.surt(u) for u in urls}]
    assert sorted(r.page_id for r in got) == sorted(want)
    text = dict((k, (h or "").encode()) for k, _, h in rows)
    assert all(r.payload == (text[r.page_id] if r.record_type == "response" else b"") for r in got)
    listed = parts.orderBy("part").collect()
    blocks = [json.loads(x) for r in listed for x in open(r.file + ".dir").read().split("\n")]
    assert [b[0] for b in blocks] == sorted(b[0] for b in blocks) and sum(b[4] for b in blocks) == len(rows) == sum(r.lines for r in listed)
    members = b"".join(gzip.decompress(open(f + ".warc.gz", "rb").read()) for f in {r.file for r in listed})
    assert members.count(b"WARC/1.1\r\n") == len(rows)


def test_surt(spark):
    cases = {None: "", "": "", "http://www.Example.com/a?b": "com,example,www)/a?b", "x://a.b": "b,a)", "a.b/c": "b,a)/c", "h://u?x/y": "u)?x/y"}
    assert {u: X.surt(u) for u in cases} == cases
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.s for r in df.select("url", X.surt_column(F.col("url")).alias("s")).collect()} == cases


def test_empty_null_and_repeated_ids(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert X.write_and_read(none, f"{tmp_path}/e").count() == 0
    odd = [(None, "http://a/", "x", "", ""), (4, "http://a/", "x", "", ""), (4, "http://a/", "x", "", ""), (None, None, None, None, None)]
    got = X.write_and_read(spark.createDataFrame(odd, SCHEMA), f"{tmp_path}/o").collect()
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [
        ("4", "response", "None"), ("4", "revisit", "4"), ("None", "response", "None"), ("None", "revisit", "4")]

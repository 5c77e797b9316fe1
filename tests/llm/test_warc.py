"""WARC archives and their capture index against the pages they were made of."""

import gzip
import hashlib
import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmend.llm import warc

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("key", T.StringType()), ("digest", T.LongType()), ("first", T.StringType()))])
LONG = "<p>" + "same words " * 20
SAME = "http://hot.example/same"


def pages():
    rows = [(7, "http://www.Example.com:80/a?b#c", LONG), (3, "https://example.com/b", LONG), (9, None, LONG), (None, "http://x.example/", LONG), (3, "https://example.com/b", LONG)]
    rows += [(20, "http://x.example/s", "short"), (21, "http://x.example/t", "short"), (22, "http://x.example/n", None), (23, "http://x.example/e", ""), (24, "not a url\r\nX-Evil: 1", "é" * 60), (25, "", "\r\n\r\n" * 40)]
    rows += [(None, "http://no.example/1", "only nulls " * 20), (None, "http://no.example/2", "only nulls " * 20), (26, "http://ü.example/größe 1", "x" * 99), (27, "http://ü.example/größe 2", "x" * 99)]
    rows += [(100 + i, SAME, f"capture {i} " * 15) for i in range(60)] + [(200, "http://y.example/long", "words and more " * 100_000)]
    return [(*r, "clash", 1, "clash") for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}"
    warc.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), path, archive=2000)
    warc.build_index(spark, path, block=4, shard=10)
    return path


def brute(rows):
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        first = min(ids, default=None) if len(raw) >= 100 else None
        revisit = first is not None and page_id != first
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def test_every_row_comes_back_through_the_index(spark):
    rows = pages()
    out = warc.digest(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, out.collect())) == brute(rows)
    assert warc.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = [(None, None, None, None, None, None)]
    assert Counter(map(tuple, warc.digest(spark.createDataFrame(nothing, SCHEMA)).collect())) == brute(nothing)


def test_records_hold_their_pages(spark, folder):
    keys = spark.createDataFrame(pages(), SCHEMA).select(warc.url_key(F.col("url")).alias("key"))
    got = warc.read_records(warc.lookup(spark, folder, keys), folder).collect()
    assert len(got) == len(pages())
    want = Counter((r[0], r[1], (r[2] or "").encode()) for r in pages())
    assert all(want[r.page_id, r.url, bytes(r.payload)] for r in got if r.record_type == "response")


def test_archives_are_plain_warc(folder):
    files = list(Path(folder.removeprefix("file://"), "archives").iterdir())
    assert len(files) > 3  # closed beyond 2000 bytes
    ids, lines = [], []
    for f in files:
        raw = gzip.decompress(f.read_bytes())  # members in a row are one stream
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n" and "X-Evil" not in fields
            assert ("WARC-Refers-To" in fields) == (fields["WARC-Type"] == "revisit")
            ids.append(fields["WARC-Record-ID"])
            lines.append(fields.get("WARC-Refers-To"))
            raw = rest[size + 4 :]
    assert len(ids) == len(pages()) and {x for x in lines if x} <= set(ids)
    assert all(uuid.UUID(x.removeprefix("<urn:uuid:").rstrip(">")) for x in ids)


def test_lookups_of_one_key_spread_over_shards_and_of_none(spark, folder):
    shards = spark.read.parquet(f"{folder}/shards").orderBy("first", "last").collect()
    assert len(shards) >= 7 and all(a["last"] <= b["first"] for a, b in zip(shards, shards[1:], strict=False))
    assert sum(s["first"] <= "example,hot)/same" <= s["last"] for s in shards) > 2
    keys = spark.createDataFrame([(SAME,), (SAME,), ("http://nobody.example/",), (None,), ("http://zz.example/",)], "url string").select(warc.url_key(F.col("url")).alias("key"))
    got = warc.lookup(spark, folder, keys).collect()
    assert sorted(r.page_id for r in got if r.key) == list(range(100, 160))
    assert [r.page_id for r in got if not r.key] == [9]  # the page without a URL


def test_a_lookup_reads_only_the_blocks_it_needs(spark, folder, monkeypatch):
    for s in spark.read.parquet(f"{folder}/shards").collect():
        shard = warc.Shard(folder, s["shard"], s["bytes"])
        assert shard.firsts == sorted(shard.firsts) and all(d[3] <= 4 for d in shard.directory)
        every = [x for i in range(len(shard.directory)) for x in shard.block(i)]
        for key in {x[0] for x in every}:
            shard.read, shard.held = 0, None
            assert list(shard.captures(key)) == [x for x in every if x[0] == key]
            assert shard.read <= 2 + sum(d[0] == key for d in shard.directory)
    assert list(shard.captures("~")) == list(shard.captures("!")) == []


def test_keys(spark):
    cases = {
        "https://www.Example.com/Path?Q=1#frag": "com,example)/Path?Q=1", "http://user:pw@example.co.uk:80": "uk,co,example)/", "http://example.com:8080/a": "com,example:8080)/a", "//example.com/x": "com,example)/x",
        "http://example.com?x": "com,example)?x", "mailto:a@b": ")a@b", "": ")/", "http://a.b/c d\n": "b,a)/c%20d%20", None: "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.key for r in df.withColumn("key", warc.url_key(F.col("url"))).collect()} == cases


def test_the_table_of_shards_is_one_file(spark, folder):
    assert spark.read.parquet(f"{folder}/shards").count() >= 7
    assert len(list(Path(folder.removeprefix("file://"), "shards").glob("part-*"))) == 1


def test_only_the_result_is_checkpointed_and_no_lookup_stays_stored(spark, monkeypatch):
    columns, stored = [], lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(warc, "kept", lambda df, f=warc.kept: (columns.append(df.columns), f(df))[1])
    before = stored()
    assert Counter(map(tuple, warc.digest(spark.createDataFrame(pages(), SCHEMA).repartition(4)).collect())) == brute(pages())
    assert columns == [["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]] and stored() <= before

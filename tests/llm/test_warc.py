import hashlib
import struct

import pytest
import zstandard

from foliant.llm import warc
from foliant.llm.common import read_file, workspace

BIG = "<p>" + "x" * 1000


def rows():
    return [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "u\nv", ""), (2, "again", BIG), (None, "n", BIG), (None, "m", BIG + "y"), (None, "m", BIG + "y"), (7, "u", "é" * 500), (8, "u", "é" * 500), (9, "u", "é" * 499)]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((j for j, _, h in rows if j is not None and (h or "") == (html or "")), default=None)
        again = len(data) >= 1000 and last is not None and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=repr)


def test_query(spark, sf, empty):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows()], "page_id long, url string, html string, refers_to string, _n int").repartition(3)
    got = warc.read_warc(warc.write_warc(df, workspace(spark, "test"))).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows())
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 100000", "url", "html")).union(pages.selectExpr("page_id + 200000", "url", "html"))
    files = warc.write_warc(pages, workspace(spark, "test"))
    assert sorted(map(tuple, warc.read_warc(files).collect()), key=repr) == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(none, workspace(spark, "test"))).count() == 0


def test_dictionary_stands_in_front(spark):
    records = [warc.record(i, f"http://host/{i}", f"<html><body>page {i} {hashlib.md5(str(i).encode()).hexdigest() * 8}</body></html>".encode(), None, False) for i in range(3000)]
    data = warc.pack(records)
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.MAGIC and len(data) < len(warc.pack(records[:1])) * len(records)
    made = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    one = zstandard.ZstdDecompressor(dict_data=made).decompressobj()
    assert one.decompress(data[8 + size :]) == records[0] and one.unused_data  # each record is a frame of its own
    assert [h["warc-record-id"] for h, _ in warc.unpack(data)] == [f"<urn:page:{i}>" for i in range(3000)]


def test_damage_is_found():
    headers, block = next(warc.unpack(warc.pack([warc.record(1, "u", b"payload", None, False)])))
    assert warc.facts(headers, block)["page_id"] == 1
    with pytest.raises(ValueError, match="damaged"):
        warc.facts(headers, block.replace(b"payload", b"Payload"))


def test_several_files_a_task(spark, sf, monkeypatch):
    monkeypatch.setattr(warc, "FILE", 20_000)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    files = warc.write_warc(pages, workspace(spark, "test"))
    assert files.count() > 4 and all(len(read_file(r["file"])) == r["n_bytes"] for r in files.collect())
    assert warc.read_warc(files).count() == pages.count()


def test_every_archive_has_a_dictionary_that_pays(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    files = warc.write_warc(pages, workspace(spark, "test")).collect()
    plain = zstandard.ZstdCompressor(level=warc.LEVEL, write_checksum=True)
    for r in files:
        data = read_file(r["file"])
        made, start = warc.leading(data)
        assert struct.unpack_from("<I", data)[0] == warc.MAGIC and len(made.as_bytes()) <= warc.DICTIONARY and start > 8
        whole = zstandard.ZstdDecompressor(dict_data=made).stream_reader(data[start:], read_across_frames=True).read()
        records = [b"WARC/1.1" + x for x in whole.split(b"WARC/1.1")[1:]]
        assert len(records) == r["n_records"] and len(data) < sum(len(plain.compress(x)) for x in records)
    for records in ([b"x"], [b"x" * 10_000_000], [bytes([i]) * 3000 for i in range(200)], [warc.record(1, "u", b"", None, False)]):
        data = warc.pack(records)
        made, start = warc.leading(data)
        assert made is not None
        got = zstandard.ZstdDecompressor(dict_data=made).stream_reader(data[start:], read_across_frames=True).read()
        assert got == b"".join(records)


def test_long_pages_and_nulls(spark):
    pages = [(i, None if i % 2 else f"http://h/{i}", f"<p>{i}</p>" * (300_000 if i == 3 else i)) for i in range(6)] + [(9, "u", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert sorted(map(tuple, warc.read_warc(warc.write_warc(df, workspace(spark, "test"))).collect()), key=repr) == brute(pages)

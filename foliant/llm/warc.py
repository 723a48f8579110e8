"""WARC files compressed record by record with a Zstandard dictionary, and their reader.

Each task writes files of its own: it gathers records up to FILE bytes, builds a dictionary from pieces spread evenly over all of
them, puts it, compressed itself, in a leading skippable frame (magic number 0x184D2A5D) and compresses every record as a
frame by itself, so that a record can be read at its place with the dictionary alone. The dictionary's size is a share of the
file's, so that it pays at every size; where there is too little to train on, the pieces themselves are the dictionary. Every file
begins with such a frame. The list of files is a table that Spark commits; files of lost attempts are never read.

Records with equal payloads of at least LEAST bytes are written once: the one with the largest page_id is the
response, the others are revisit records that refer to it. Groups of copies are found by a map-side aggregate; large ones are
looked up in a broadcast table of a bounded number of rows (spread_join), so a group may hold any part of the rows.

Defined results: a null html counts as empty, a null url as an empty one; rows that repeat both the page_id and the payload of a
response are responses too; a very long html is one record, held whole in memory while it is written; a null page_id revisits the largest other one, and if a group has none all are responses;
an empty table gives no files and an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_file, slices, spread, spread_join, staged, table, text_of, workspace, write_file

LEAST = 1000  # bytes of a payload that may be revisited
SHARED, LEAST_SHARED = 4096, 64  # groups of more than such a part of all rows, and that many, are looked up apart
FILE = 32 << 20  # bytes of records after which a task starts another file
DICTIONARY, LEAST_DICTIONARY = 64 << 10, 256  # bytes
SHARE = 64  # records have so many times the bytes of their dictionary
PIECE = 8 << 10  # bytes that are trained on together
SAMPLE = 2 << 20  # bytes of pieces that a dictionary is trained on, at most
LEVEL = 3
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if revisit else http + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def pieces(records: list[bytes]) -> list[bytes]:
    """Parts of at most PIECE bytes, spread evenly over all records, of SAMPLE bytes together at most."""
    parts = [r[i : i + PIECE] for r in records for i in range(0, len(r), PIECE)]
    return parts[:: max(1, -(-sum(map(len, parts)) // SAMPLE))]


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Built from the records of a file."""
    parts = pieces(records)
    size = min(DICTIONARY, max(LEAST_DICTIONARY, sum(map(len, records)) // SHARE))
    try:
        return zstandard.train_dictionary(size, parts)
    except zstandard.ZstdError:  # too few records, or too much alike: what they have is taken as it is
        some = b"".join(p[: max(64, size // max(1, len(parts)))] for p in parts[:: max(1, len(parts) * 64 // size)])
        return zstandard.ZstdCompressionDict(some[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """A file of records."""
    made = dictionary(records)
    raw = zstandard.ZstdCompressor(level=19, write_checksum=True).compress(made.as_bytes())
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *(press.compress(r) for r in records)])


def leading(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary in the leading frame, compressed or as it is, and where the records begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        return None, 0
    (n,) = struct.unpack_from("<I", data, 4)
    raw = data[8 : 8 + n]
    if raw[:4] == zstandard.FRAME_HEADER:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), 8 + n


def unpack(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and the block of each record."""
    made, start = leading(data)
    source = zstandard.ZstdDecompressor(dict_data=made).stream_reader(io.BytesIO(memoryview(data)[start:]), read_across_frames=True)
    with io.BufferedReader(source, 1 << 20) as f:
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError("not a record")
            headers = {}
            while (line := f.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.decode().partition(":")
                headers[name.lower()] = value.strip()
            block = f.read(int(headers["content-length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            yield headers, block


def facts(headers: dict[str, str], block: bytes) -> dict:
    """What a record tells about its page."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, said):
        raise ValueError("a payload is damaged")
    page = lambda name: int(x) if (x := headers[name].removeprefix("<urn:page:").rstrip(">")) else None
    return {"page_id": page("warc-record-id"), "payload_bytes": length, "payload_digest": said, "record_type": headers["warc-type"], "refers_to": page("warc-refers-to") if revisit else None}


FILES = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
FACTS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long"), text_of("url").alias("url"), text_of("html").alias("html"))
    rows = rows.withColumn("_sha", F.when(F.octet_length("html") >= LEAST, F.sha2("html", 256)))
    groups = rows.where("_sha is not null").groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _last is not null")
    groups = groups.withColumn("_key", F.xxhash64("_sha"))
    # short pages match nothing: they take part with a random key, or all would go to one task as nulls
    rows = rows.withColumn("_sha", F.coalesce("_sha", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))).withColumn("_key", F.xxhash64("_sha"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    met = spread_join(rows, groups, ["_sha", "_key"], "_n", max(LEAST_SHARED, pages.count() // SHARED), ["page_id"])
    return met.select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages below path; the list of files: file, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal place, held, size
            data = pack(held)
            name = f"{path}/warc/{part:06d}-{place:04d}-{uuid.uuid4().hex}.warc.zst"
            write_file(name, data)
            row = {"file": name, "n_records": len(held), "n_bytes": len(data)}
            place, held, size = place + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=FILES)

        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(record(page_id, url, html.encode(), refers_to, refers_to is not None))
                size += len(held[-1])
                if size >= FILE:
                    yield flush()
        if held:
            yield flush()

    return staged(revisits(spread(pages)).mapInArrow(run, "file string, n_records long, n_bytes long"), f"{path}/files")


def read_warc(files: DataFrame) -> DataFrame:
    """From the list of files: page_id, payload_bytes, payload_digest, record_type, refers_to, as read from the archives."""
    width = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for headers, block in unpack(read_file(file)):
                    rows.append(facts(headers, block))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema=FACTS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=FACTS)

    return files.select("file").repartition(width, "file").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages"), workspace(spark, "warc")))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM g
"""

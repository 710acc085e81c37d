"""WARC archives in Zstandard frames: writer and reader.

An archive starts with a skippable frame that holds its dictionary; then comes one frame a record. Spark's
text writer stores the frames through its commit protocol on any file system: the separator that it puts
after each row is an empty skippable frame, which decoders pass over. Each task writes one archive, so
the input split bounds its size.

A record is a ``response`` with an HTTP head and the payload, or a ``revisit`` that has the head only and
names the response with the same payload.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

# Fixed values of the formats: Zstandard frame magic, WARC dictionary frame magic, an empty skippable frame.
FRAME, DICTIONARY, SEPARATOR = 0xFD2FB528, 0x184D2A5D, "P*M\x18\0\0\0\0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def roles(pages: DataFrame, least: int = 100, id_col: str = "page_id", html_col: str = "html", most_broadcast: int = 200_000) -> DataFrame:
    """pages with __payload, __digest and __refers (the smallest id with an equal payload of at least ``least`` bytes, for revisits)."""
    rows = pages.withColumn("__payload", F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))).withColumn("__digest", F.sha2("__payload", 256))
    groups = materialize(
        rows.where(F.octet_length("__payload") >= least).groupBy("__digest").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    )
    small = groups.count() <= most_broadcast  # 72 bytes a row; beyond that a shuffled join, whose hot keys AQE splits
    joined = rows.join(F.broadcast(groups) if small else groups, "__digest", "left")
    later = F.col("__first").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) > F.col("__first")))
    return joined.withColumn("__refers", F.when(later, F.col("__first"))).drop("__first")


def record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers: int | None) -> bytes:
    """The bytes of one WARC record."""
    clean = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {clean}"] if clean is not None else []
    head += [f"WARC-Refers-To: <urn:page:{refers}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 1 << 15):
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes], level: int = 3, sampled: int = 200) -> Iterator[bytes]:
    """The dictionary's frame, then a frame for each record."""
    import zstandard

    first = [r for _, r in zip(range(sampled), records, strict=False)]
    if not first:
        return
    known = dictionary([r[:8192] for r in first])
    content = known.as_bytes()
    yield struct.pack("<II", DICTIONARY, len(content)) + content
    packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
    yield from map(packer.compress, first)
    yield from map(packer.compress, records)


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write a record for each row of pages (page_id, url, html) below path; other columns are left out.

    Null html is an empty payload, a null url has no target header, a null id is written as None. Repeated
    rows get a record each. No rows give no archive.
    """
    rows = roles(pages.select("page_id", "url", "html"), least).select("page_id", "url", "__digest", "__payload", "__refers")

    def pack(batches):
        import pandas as pd

        whole = lambda x: None if pd.isna(x) else int(x)
        records = (
            record(whole(i), None if u is None else u, d, bytes(p), whole(r))
            for b in batches
            for i, u, d, p, r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)
        )
        yield from in_batches(((f,) for f in frames(records)), ["frame"])

    def in_batches(rows, names):
        import pyarrow as pa

        held, weight = [], 0
        for row in rows:
            held.append(row)
            weight += len(row[0])
            if weight > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held, strict=True)], names)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held, strict=True)], names)

    packed = rows.mapInArrow(pack, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, by its block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    known = zstandard.get_frame_parameters(head)
    at += zstandard.frame_header_size(head)
    while True:
        if at + 3 > len(data):
            raise ValueError("archive ends inside a frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * known.has_checksum


def records_of(archive: bytes) -> Iterator[bytes]:
    """The records of an archive; raises ValueError or ZstdError where it is damaged."""
    import zstandard

    data, at, unpacker, first = memoryview(archive), 0, zstandard.ZstdDecompressor(), True
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("archive ends inside a frame header")
        magic, length = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + length
            if end > len(data):
                raise ValueError("archive ends inside a skippable frame")
            if magic == DICTIONARY:
                if not first:
                    raise ValueError("the dictionary does not lead the archive")
                content = bytes(data[at + 8 : end])
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
        elif magic == FRAME:
            end = frame_end(data, at)
            if end > len(data):
                raise ValueError("archive ends inside a frame")
            yield unpacker.decompress(data[at:end])
        else:
            raise ValueError(f"no frame at byte {at}")
        at, first = end, False


def headers(data: bytes, kind: bytes) -> tuple[dict[str, str], int]:
    """The header fields by lower-case name, and where what follows them starts."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(kind):
        raise ValueError("no header block of kind " + kind.decode())
    fields = {}
    for line in data[:end].decode().split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"malformed header line {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def whole_number(fields: dict[str, str], name: str) -> int:
    if not re.fullmatch(r"[0-9]+", fields.get(name, "")):
        raise ValueError(f"no whole number in {name}")
    return int(fields[name])


def page_of(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+|None)>", identifier)
    if not found:
        raise ValueError(f"malformed record id {identifier[:60]!r}")
    return None if found[1] == "None" else int(found[1])


def parse(data: bytes) -> tuple | None:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a response or revisit, validated.

    Records of other types (warcinfo, request, metadata and the like) have their length checked and give None.
    """
    fields, start = headers(data, b"WARC/1.")
    missing = {"warc-type", "warc-record-id", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"record without {sorted(missing)}")
    if len(data) != start + whole_number(fields, "content-length") + 4 or data[-4:] != b"\r\n\r\n":
        raise ValueError("record length and Content-Length differ")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    if "warc-payload-digest" not in fields:
        raise ValueError("record without warc-payload-digest")
    block = data[start:-4]
    http, body = headers(block, b"HTTP/1.")
    payload, size = block[body:], whole_number(http, "content-length")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload does not fit its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("revisit with a payload or without what it refers to")
    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, refers, size, digest, payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit below path (see READ); a damaged archive fails the job. No archive gives no rows.

    An archive is read whole by one task, so it must fit in its memory; the writer's are bounded by the input split.
    """
    import pyarrow as pa

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def unpack(batches):
        held, weight = [], 0
        for b in batches:
            for k in range(b.num_rows):
                for data in records_of(b.column(0)[k].as_py()):
                    found = parse(data)
                    held += [found] if found else []
                    weight += len(data)
                    if held and weight > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(unpack, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""

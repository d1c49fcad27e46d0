"""WARC archives in Zstandard: one frame for each record, compressed with a dictionary that leads the archive.

An archive begins with a skippable frame that holds the dictionary; every record is a frame of its own, so a reader can
start at any of them.  Tasks write archives of bounded size into the shared folder and hand on their names; only names
of finished tasks are read, so a task that is run again leaves no record twice.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperfold.llm.common import shared_uri, store, table

SKIPPABLE = 0x184D2A5D  # fixed value: magic number of the frame that holds the dictionary
ARCHIVE_BYTES = 32 << 20
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 200, 16384, 32768  # the dictionary is fitted on so much, at most
REVISIT_BYTES = 1000  # payloads from this size on are stored once
_WINDOW = 1 << 18


class ArchiveError(ValueError):
    """A record that breaks the format."""


def dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary fitted on some payloads; too few of them are a dictionary by themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(payloads)[:DICTIONARY_BYTES] or b"HTTP/1.1 200 OK\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or, if it refers to another page, a revisit record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """A record's fields, after its headers and lengths have been checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ArchiveError("no WARC header")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Payload-Digest", "Content-Length"):
        if name not in fields:
            raise ArchiveError(f"no {name}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("the block's length is not the one stated")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    lengths = [int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not found or len(lengths) != 1:
        raise ArchiveError("no HTTP header")
    if fields["WARC-Type"] == "response" and (len(payload) != lengths[0] or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("the payload is not the one stated")
    if fields["WARC-Type"] == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ArchiveError("a revisit has no payload and refers to a record")

    def page(urn: str | None) -> int | None:
        name = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return int(name) if name and name != "none" else None

    return {
        "page_id": page(fields["WARC-Record-ID"]), "payload_bytes": lengths[0], "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload,
    }


class Writer:
    """Writes records into archives of at most about ARCHIVE_BYTES, each complete in itself."""

    def __init__(self, folder: str, words: bytes) -> None:
        self.folder, self.words = folder, words
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
        self.out, self.name, self.size, self.records = None, "", 0, 0

    def add(self, data: bytes) -> Iterator[tuple[str, int]]:
        if self.out is not None and self.size >= ARCHIVE_BYTES:
            yield self.closed()
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
            fs, path = store(self.name)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.size, self.records = fs.open_output_stream(path), 0, 0
            self.out.write(struct.pack("<II", SKIPPABLE, len(self.words)) + self.words)
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.size, self.records = self.size + len(frame), self.records + 1

    def closed(self) -> tuple[str, int]:
        self.out.close()
        self.out = None
        return self.name, self.records


def records_of(stream) -> Iterator[bytes]:
    """The records of an archive, a frame at a time, read in windows; a broken or cut archive is an error."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ArchiveError("no dictionary in front")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    decompressor, ahead = zstandard.ZstdDecompressor(dict_data=words), b""
    while True:
        ahead = ahead or stream.read(_WINDOW)
        if not ahead:
            return
        frame, parts = decompressor.decompressobj(), []
        while True:
            parts.append(frame.decompress(ahead))
            ahead = frame.unused_data if frame.eof else stream.read(_WINDOW)
            if frame.eof:
                break
            if not ahead:
                raise ArchiveError("the last frame is cut")
        yield b"".join(parts)


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); the names and record counts of the archives.

    Of equal payloads of at least REVISIT_BYTES the row with the largest page_id is the response and the others revisit
    it; rows that repeat this page_id too are responses.  Null html is an empty payload, a null url leaves its header
    out, a null page_id never is the one referred to while another is there.
    """
    spark = pages.sparkSession
    folder = folder or shared_uri(spark, "llm-warc")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    picked = table(pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES), "dictionary-pages")
    sample = pages.join(picked, "page_id", "left_semi").select(F.substring("payload", 1, SAMPLE_CHARS).alias("p")).limit(SAMPLE_PAGES)
    words = dictionary([bytes(r["p"]) for r in sample.collect() if r["p"]])
    named = pages.withColumn("digest", F.sha1("payload"))
    large = named.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    target = F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first"))
    joined = named.join(large.select("digest", "first"), "digest", "left").select("page_id", "url", "payload", "digest", target.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = Writer(folder, words), []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                done += writer.add(record(*row))
        if writer.out is not None:
            done.append(writer.closed())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return table(joined.mapInArrow(run, "archive string, records bigint"), "archives")


_FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives named: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload).

    About a task for each archive; no archives give no rows.
    """
    fields = _FIELDS.append(pa.field("payload", pa.binary())) if payloads else _FIELDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = store(name)
                rows, seen = [], 0
                with fs.open_input_stream(path) as stream:
                    for data in records_of(stream):
                        row = parsed(data)
                        rows.append({k: row[k] for k in fields.names})
                        seen += 1
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows = []
                if seen != expected:
                    raise ArchiveError(f"{name}: {seen} records of {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    # names are small, so left to itself Spark would merge them into one task
    each = archives.select("archive", "records").repartition(max(1, archives.count()), "archive")
    return each.mapInArrow(run, schema)

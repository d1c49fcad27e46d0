"""Token ids as length-delimited binary records, with an offset index beside each file for reads in any order.

A file is a row of records, each framed as: length of the payload (8 bytes, little-endian like all numbers), masked
checksum of these 8 bytes (4), payload, masked checksum of the payload (4).  The checksum is CRC-32, rotated right by 15
bits plus a constant, so that data that hold checksums themselves are told apart.  A payload is a byte of flags (1: the
id is null, 2: ids take 4 bytes instead of 2), the document's id (8) and its token ids.  The index has for each record
its offset in the file (8) and the number of token ids of the file before it (8).

Rows are dealt into ranges of doc_id, so files follow each other; each task writes files of bounded size below names of
its own and hands on these names.  Only files of finished tasks are named by the manifest, whatever was run again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperfold.llm.common import shared_uri, store, table
from paperfold.llm.tokens import default_path, encoder

END_ID = 2
FILE_BYTES = 64 << 20
_MASK = 0xA282EAD8  # fixed value: added to a rotated checksum
_LENGTH, _SUM, _DOC, _ENTRY = 8, 4, 9, 16  # bytes of a length, a checksum, the front of a payload, an entry of the index
_NULL, _WIDE = 1, 2
_BUFFER, _OPEN = 1 << 20, 16  # bytes read ahead; files a task keeps open in reads by position
_BLOCK = 4096  # positions


class RecordError(ValueError):
    """A file that breaks the format."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return struct.pack("<8sI", head, masked(head)) + payload + struct.pack("<I", masked(payload))


def packed(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """The payload of a document."""
    return struct.pack("<Bq", (doc_id is None) * _NULL | wide * _WIDE, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_DOC)
    return None if flags & _NULL else doc_id, ids.astype("<u4")


def next_payload(stream) -> bytes | None:
    """The payload at the place of a stream, its length and checksums verified; None at the end of the file."""
    head = stream.read(_LENGTH + _SUM)
    if not head:
        return None
    if len(head) < _LENGTH + _SUM or masked(head[:_LENGTH]) != int.from_bytes(head[_LENGTH:], "little"):
        raise RecordError("the length of a record is damaged")
    size = int.from_bytes(head[:_LENGTH], "little")
    body = stream.read(size + _SUM)
    if len(body) != size + _SUM or masked(body[:size]) != int.from_bytes(body[size:], "little"):
        raise RecordError("a record is damaged")
    return body[:size]


class Writer:
    """Writes records into files of at most about FILE_BYTES, each with its index."""

    def __init__(self, folder: str) -> None:
        self.folder, self.out = folder, None

    def add(self, payload: bytes, tokens: int) -> Iterator[tuple[str, int, int]]:
        if self.out is not None and self.at >= FILE_BYTES:
            yield self.closed()
        if self.out is None:
            self.name, self.at, self.tokens, self.index = f"{self.folder}/{uuid.uuid4().hex}", 0, 0, bytearray()
            self.fs, self.path = store(self.name)
            self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
            self.out = self.fs.open_output_stream(self.path + ".rec", buffer_size=_BUFFER)
        self.index += struct.pack("<QQ", self.at, self.tokens)
        data = framed(payload)
        self.out.write(data)
        self.at, self.tokens = self.at + len(data), self.tokens + tokens

    def closed(self) -> tuple[str, int, int]:
        """Name, records, token ids of the file written."""
        self.out.close()
        self.out = None
        with self.fs.open_output_stream(self.path + ".idx") as index:
            index.write(bytes(self.index))
        return self.name, len(self.index) // _ENTRY, self.tokens


def write(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token ids of each row of ``docs`` (doc_id, text) and an end id, in ascending doc_id order.

    Returns the manifest, a row for each file: file, number (from 0, in order), records, tokens, first_record,
    first_token.  Null ids come first; rows of one id are ordered by a hash of their text and repeated rows follow each
    other; a null text has the end id alone; other columns are ignored; an empty table makes no files.
    """
    folder, path = folder or shared_uri(docs.sparkSession, "llm-records"), tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, coder, done = Writer(folder), encoder(path), []
        wide = coder.tokenizer.get_vocab_size() > 1 << 16
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, _, ids, at in coder.columns(batch.column(1)):
                for k, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                    done += writer.add(packed(names[first + k], np.append(ids[a:b], end_id), wide), b - a + 1)
        if writer.out is not None:
            done.append(writer.closed())
        file, records, tokens = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [])
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(file), pa.int64()), pa.array(range(len(file)), pa.int64()), pa.array(file, pa.string()), pa.array(records, pa.int64()), pa.array(tokens, pa.int64())],
            ["part", "nth", "file", "records", "tokens"],
        )

    files = table(dealt.mapInArrow(run, "part bigint, nth bigint, file string, records bigint, tokens bigint"), "record-files")
    order = Window.orderBy("part", "nth")  # a row for each file
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    return table(files.select(
        "file", (F.row_number().over(order) - 1).cast("long").alias("number"), "records", "tokens",
        F.coalesce(F.sum("records").over(before), none).alias("first_record"), F.coalesce(F.sum("tokens").over(before), none).alias("first_token"),
    ), "record-manifest")


def _row(payload: bytes, position: int, start: int) -> dict:
    doc_id, ids = unpacked(payload)
    return {"position": position, "doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes()), "ids": ids}


_FIELDS = [("position", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
_COLUMNS = "position bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _batches(rows: Iterator[dict], ids: bool) -> Iterator[pa.RecordBatch]:
    schema, held, size = pa.schema(_FIELDS + [("ids", pa.list_(pa.int64()))] * ids), [], 0
    for row in rows:
        held.append({k: row[k] for k in schema.names})
        size += row["n_tokens"]
        if len(held) == 1000 or size > 1 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _records(file: str, records: int, tokens: int) -> Iterator[tuple[bytes, int]]:
    """All payloads of a file and the token ids before each, held against its index."""
    fs, path = store(file)
    with fs.open_input_stream(path + ".rec", buffer_size=_BUFFER) as stream, fs.open_input_stream(path + ".idx", buffer_size=_BUFFER) as index:
        at = before = seen = 0
        while (payload := next_payload(stream)) is not None:
            if index.read(_ENTRY) != struct.pack("<QQ", at, before):
                raise RecordError(f"{file}: the index says otherwise")
            yield payload, before
            at, seen = at + _LENGTH + 2 * _SUM + len(payload), seen + 1
            before += (len(payload) - _DOC) // (4 if payload[0] & _WIDE else 2)
        if (seen, before) != (records, tokens) or index.read(1):
            raise RecordError(f"{file}: {seen} records of {records}, {before} ids of {tokens}")


def read(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """(position, doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of all records, whole files at a time.

    ``position`` numbers the records of all files, ``start`` counts the token ids of all records before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                found = enumerate(_records(f["file"], f["records"], f["tokens"]))
                yield from _batches((_row(p, f["first_record"] + k, f["first_token"] + before) for k, (p, before) in found), ids)

    spread = manifest.repartitionById(max(1, manifest.count()), F.col("number").cast("int"))  # a task for each file
    return spread.mapInArrow(run, _COLUMNS + ", ids array<bigint>" * ids)


class _Open:
    """Files that a task reads records from by their number; the ones used last stay open."""

    def __init__(self) -> None:
        self.files: OrderedDict = OrderedDict()

    def get(self, file: str, k: int) -> tuple[bytes, int]:
        if file not in self.files:
            fs, path = store(file)
            self.files[file] = fs.open_input_file(path + ".rec"), fs.open_input_file(path + ".idx")
            if len(self.files) > _OPEN:
                for old in self.files.popitem(last=False)[1]:
                    old.close()
        self.files.move_to_end(file)
        data, index = self.files[file]
        index.seek(k * _ENTRY)
        entry = index.read(_ENTRY)
        if len(entry) != _ENTRY:
            raise RecordError(f"{file} has no record {k}")
        offset, before = struct.unpack("<QQ", entry)
        data.seek(offset)
        return next_payload(data), before


def _at(placed: DataFrame, ids: bool) -> DataFrame:
    """Read (file, k, position, first_token) rows through the index, in the order they stand in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Open()

        def rows() -> Iterator[dict]:
            for batch in batches:
                for f in batch.to_pylist():
                    payload, before = files.get(f["file"], f["k"])
                    yield _row(payload, f["position"], f["first_token"] + before)

        yield from _batches(rows(), ids)

    return placed.select("file", "k", "position", "first_token").mapInArrow(run, _COLUMNS + ", ids array<bigint>" * ids)


def pick(manifest: DataFrame, wanted: DataFrame, ids: bool = True) -> DataFrame:
    """The records at ``wanted`` (position), as often as they are asked for; positions beyond the end and null give nothing."""
    last = F.col("first_record") + F.col("records") - 1
    blocks = manifest.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_record") / _BLOCK), F.floor(last / _BLOCK))))
    asked = wanted.select(F.col("position").cast("long")).withColumn("block", F.floor(F.col("position") / _BLOCK))
    placed = asked.join(blocks, "block").where(F.col("position").between(F.col("first_record"), last))
    placed = placed.withColumn("k", F.col("position") - F.col("first_record"))
    return _at(placed.sortWithinPartitions("file", "k"), ids)


def shuffled(manifest: DataFrame, seed: int, ids: bool = True) -> DataFrame:
    """All records in an order drawn by ``seed``: partitions are ranges of a keyed hash of the position, in its order."""
    each = manifest.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1)))
    each = each.withColumn("position", F.col("first_record") + F.col("k")).withColumn("draw", F.xxhash64("position", F.lit(seed)))
    return _at(each.repartitionByRange("draw").sortWithinPartitions("draw"), ids)

"""Reader of binary record files: one record after another, each with its checksum.

Layout, little-endian: crc32 (4 bytes, over all that follows in the record), time in ns (8), sequence number (8), flags
(1: bit 0 tombstone, bit 1 batch member, bit 2 last of its batch), key length (4), value length (4), key, value.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import HEADER, LOG_SCHEMA, MAX_KEY, MAX_VALUE, record_size

_HEAD = struct.Struct("<IqQBII")


def parse_records(data: bytes) -> Iterator[tuple]:
    """(offset, seq, ts_ns, flags, key, value) of each record up to the first that is cut short, implausible or damaged."""
    view, at = memoryview(data), 0
    while at + HEADER <= len(view):
        crc, ts, seq, flags, klen, vlen = _HEAD.unpack_from(view, at)
        end = at + HEADER + klen + vlen
        if not 0 < klen <= MAX_KEY or vlen > MAX_VALUE or end > len(view) or zlib.crc32(view[at + 4 : end]) != crc:
            return
        yield at, seq, ts, flags, bytes(view[at + HEADER : at + HEADER + klen]), bytes(view[at + HEADER + klen : end])
        at = end


def _little(c: Column, size: int) -> Column:
    """A whole number as so many bytes, the lowest first, in hexadecimal."""
    digits = F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])


def record_bytes() -> Column:
    """A log's record as it is in a file."""
    flag = lambda c, bit: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(bit)).otherwise(F.lit(0))
    key, value = F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    flags = flag("tomb", 1) + flag("batch", 2) + flag("batch_end", 4)
    body = F.concat(_little(F.col("ts_ns"), 8), _little(F.col("seq"), 8), _little(flags, 1), _little(F.octet_length(key), 4), _little(F.octet_length(value), 4), F.hex(key), F.hex(value))
    return F.unhex(F.concat(_little(F.crc32(F.unhex(body)), 4), body))


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """A log from the ``*.data`` files of a folder: see :func:`parse_files`.

    Files are read in parallel, one by one and whole; a file has at most 2 GB, and writers of this format begin a new
    one far below that.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.data").load(path)
    return parse_files(files.select(F.regexp_extract("path", r"(\d+)\.data$", 1).cast("long").alias("file_id"), "content"))


def parse_files(files: DataFrame) -> DataFrame:
    """A log from (file_id, content), with file_id and the record's place in the file.

    Reading a file ends at the first record that is cut short, implausible or damaged.  A run of batch members gets a
    batch_id of its own; use ``batch_gate`` to leave out unfinished ones.
    """
    schema = "file_id long, pos long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]
    names = ["file_id", "pos", *LOG_SCHEMA.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for file_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, batch = [], None
                for at, seq, ts, flags, key, value in parse_records(content.as_buffer() if content.is_valid else b""):
                    inside, ends = bool(flags & 2), bool(flags & 4)
                    batch = (batch if batch is not None else file_id << 32 | at) if inside else batch
                    rows.append((file_id, at, key, seq, ts, bool(flags & 1), inside, ends, batch if inside else None, value))
                    batch = None if ends else batch
                    if len(rows) >= 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return files.mapInArrow(run, schema)


#: Fixed value: the layout of a hint file's entries before the key.
_HINT = struct.Struct("<QBQII")


def parse_hints(data: bytes, magic: bytes) -> list[tuple] | None:
    """(seq, flags, pos, size, key) of a hint file's entries; None if it can't be used, and its data file must be read.

    ``magic`` is what the writer's hint files begin with.
    """
    view, at, out = memoryview(data), len(magic), []
    if bytes(view[:at]) != magic:
        return None
    while at < len(view):
        if at + _HINT.size > len(view):
            return None
        seq, flags, pos, size, klen = _HINT.unpack_from(view, at)
        at += _HINT.size
        if not 0 < klen <= MAX_KEY or at + klen > len(view):
            return None
        out.append((seq, flags, pos, size, bytes(view[at : at + klen])))
        at += klen
    return out


def read_hint_files(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(file_id, pos, key, seq, tomb, size) of all records of a folder's files, without their values.

    From the ``*.hint`` file of each data file where that can be used, else from the data file itself; hints without a
    data file are not looked at.  ``magic`` is what the writer's hint files begin with.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{data,hint}").load(path)
    files = files.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("file_id"), F.col("path").endswith(".hint").alias("hint"), "content")
    # Hints first, so that a data file is only shipped where its hint fails.
    schema = "file_id long, usable boolean, pos long, key binary, seq long, tomb boolean, size long"
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = parse_hints(content.as_buffer(), magic)
                rows = [(file_id, found is not None, None, None, None, None, None)]
                rows += [(file_id, True, pos, key, seq, bool(flags & 1), size) for seq, flags, pos, size, key in found or []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    hints = files.where("hint").select("file_id", "content").mapInArrow(run, schema)
    data = files.where("not hint").select("file_id", "content")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.data").load(path).select(F.regexp_extract("path", r"(\d+)\.data$", 1).cast("long").alias("file_id"))
    usable = hints.where("usable and key is null").select("file_id")
    scanned = parse_files(data.join(usable, "file_id", "left_anti").select("file_id", "content"))
    scanned = scanned.select("file_id", "pos", "key", "seq", "tomb", record_size().alias("size"))
    return hints.where("key is not null").join(listed, "file_id", "left_semi").select(*scanned.columns).unionByName(scanned)

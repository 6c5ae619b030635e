"""What a log record is: schema, sizes, limits, checksums and the errors of the store."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of keys and values, and the bytes that a record has besides them.
MAX_KEY, MAX_VALUE, HEADER = 64 * 1024, 256 * 1024 * 1024, 29


class StoreError(Exception):
    """Base of all errors of the store."""


class KeyNotFound(StoreError):
    """The key is missing or deleted."""


class StoreClosed(StoreError):
    """The handle was closed."""


class EmptyKey(StoreError):
    """Keys have at least one byte."""


class KeyTooLarge(StoreError):
    """Keys have at most ``MAX_KEY`` bytes."""


class ValueTooLarge(StoreError):
    """Values have at most ``MAX_VALUE`` bytes."""


class BatchMismatch(StoreError):
    """A batch needs as many values as keys."""


class CommitConflict(StoreError):
    """Another writer published this version first."""


class CorruptRecord(StoreError):
    """A record does not match its checksum, or breaks the rules for records."""


#: What a read of a damaged record fails with.
DAMAGED = "a record does not match its checksum"


class NeedFullSync(StoreError):
    """What was asked for was compacted away; start from a snapshot."""


def log_schema(kind: T.DataType | None = None) -> T.StructType:
    """Columns of a log whose keys and values are of ``kind`` (binary unless said otherwise)."""
    kind = kind or T.BinaryType()
    return T.StructType([
        T.StructField("key", kind), T.StructField("seq", T.LongType()), T.StructField("ts_ns", T.LongType()), T.StructField("tomb", T.BooleanType()),
        T.StructField("batch", T.BooleanType()), T.StructField("batch_end", T.BooleanType()), T.StructField("batch_id", T.LongType()), T.StructField("value", kind),
    ])


LOG_SCHEMA = log_schema()


def record_size(key: str | Column = "key", value: str | Column = "value") -> Column:
    """Bytes of a record on disk; a null value has none."""
    return (F.lit(HEADER) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def record_crc(df: DataFrame) -> Column:
    """CRC-32 over a record's sequence, flags, key and value."""
    text = lambda c: F.col(c).cast("string").cast("binary")
    return F.crc32(F.concat(text("seq"), F.when(F.col("tomb"), F.lit("t")).otherwise(F.lit("p")).cast("binary"), F.col("key").cast("binary"), F.lit(b"\0"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))))


def faults(key: str = "key", value: str = "value") -> Column:
    """The first rule that a record breaks, or null."""
    return (
        F.when(F.col(key).isNull() | (F.octet_length(key) == 0), "empty key")
        .when(F.octet_length(key) > MAX_KEY, "key too large")
        .when(F.octet_length(value) > MAX_VALUE, "value too large")
    )


def refused(fault: Column) -> Column:
    """True where there is no fault; fails the job that meets one, with a message that :func:`fault_of` reads."""
    return F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("<fault:"), fault, F.lit(">"))).cast("boolean"))


def fault_of(error: Exception) -> str | None:
    """The fault that a job failed with, if that is why."""
    found = re.search("<fault:([a-z ]+)>", str(error))
    return found and found[1]


@contextmanager
def sound() -> Iterator[None]:
    """A job that fails because of a damaged record raises :class:`CorruptRecord`."""
    try:
        yield
    except StoreError:
        raise
    except Exception as e:
        if DAMAGED in str(e):
            raise CorruptRecord(DAMAGED) from e
        raise


_ERRORS = {"empty key": EmptyKey, "key too large": KeyTooLarge, "value too large": ValueTooLarge}


def raise_fault(fault: str | None, what: str = "") -> None:
    if fault:
        raise _ERRORS[fault](f"{fault} {what}".strip())

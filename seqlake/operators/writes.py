"""New records: sequence numbers, puts, deletes, batches, and records of other logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fault_of, faults, raise_fault, refused
from ..functions.tables import numbered, with_position
from .state import live

__all__ = ["puts", "records_of", "tombstones", "missing_keys", "apply_records", "input_faults", "deduplicated"]


def puts(rows: DataFrame, base: int, order: str, batch_id: int | None = None, ts_ns: int = 0) -> DataFrame:
    """Records for (key, value) rows, numbered after ``base`` in the order of ``order``: of equal keys the last wins.

    With a ``batch_id`` they are one batch, whose last record ends it.  Rows are validated as they are numbered: a bad
    one raises its error here.
    """
    try:
        placed, last = numbered(rows.select("key", "value", order).where(refused(faults())), order)
    except Exception as e:
        raise_fault(fault_of(e))
        raise
    return records_of(placed, base, last, batch_id, ts_ns)


def records_of(placed: DataFrame, base: int, last: int, batch_id: int | None = None, ts_ns: int = 0) -> DataFrame:
    """Records for (key, value, pos) rows, of which ``last`` is the last position."""
    inside = F.lit(batch_id is not None)
    return placed.select(
        "key", (F.lit(base) + F.col("pos")).cast("long").alias("seq"), F.lit(ts_ns).cast("long").alias("ts_ns"), F.lit(False).alias("tomb"), inside.alias("batch"),
        (inside & F.coalesce(F.col("pos") == F.lit(last), F.lit(False))).alias("batch_end"), F.lit(batch_id).cast("long").alias("batch_id"), "value",
    )


def tombstones(log: DataFrame, keys: DataFrame, base: int, ts_ns: int = 0) -> DataFrame:
    """A tombstone for each of ``keys`` that is live, numbered after ``base`` in order of keys; others leave no record."""
    kind = log.schema["value"].dataType
    there = live(log.join(keys.select("key").distinct(), "key", "left_semi")).select("key")
    return with_position(there, "key").select(
        "key", (F.lit(base) + F.col("pos")).cast("long").alias("seq"), F.lit(ts_ns).cast("long").alias("ts_ns"), F.lit(True).alias("tomb"), F.lit(False).alias("batch"),
        F.lit(False).alias("batch_end"), F.lit(None).cast("long").alias("batch_id"), F.lit("").cast(kind).alias("value"),
    )


def missing_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of ``keys`` that are missing or deleted."""
    return keys.select("key").distinct().join(live(log).select("key"), "key", "left_anti")


def apply_records(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both logs: records keep their numbers, and :func:`latest` makes the order and repeats of arrival harmless."""
    return log.unionByName(incoming.select(*log.columns))


def deduplicated(log: DataFrame) -> DataFrame:
    """One of the records with equal key and sequence number, which are replays of one record."""
    return log.dropDuplicates(["key", "seq"])


def input_faults(rows: DataFrame) -> DataFrame:
    """(empty_keys, large_keys, large_values, rows): how many rows break which rule; one row."""
    fault = faults()
    return rows.select(fault.alias("fault")).agg(
        F.count_if(F.col("fault") == "empty key").alias("empty_keys"), F.count_if(F.col("fault") == "key too large").alias("large_keys"),
        F.count_if(F.col("fault") == "value too large").alias("large_values"), F.count("*").alias("rows"),
    )

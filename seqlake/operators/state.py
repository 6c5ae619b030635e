"""State of a log: for each key the record with the highest sequence number, and only then no tombstones.

Filtering tombstones first would bring deleted keys back; nothing in this package does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import record_size

__all__ = ["latest", "latest_by_window", "live", "index_view", "signed_size", "batch_gate", "unfinished_batches", "strip_batches", "compact_log", "same_seq_conflicts"]


def _newest(log: DataFrame) -> list[Column]:
    """What is greatest for the record of a key that counts.

    Of records with equal key and sequence, which are replays of one, that of the first commit counts where the log says
    which commit a record is of; else, and within a commit, the one with the greatest hash, which is the same each time.
    """
    rest = [c for c in log.columns if c not in ("key", "seq", "commit_id")]
    return [F.col("seq"), *([-F.col("commit_id")] if "commit_id" in log.columns else []), F.xxhash64(*rest)]


def latest(log: DataFrame) -> DataFrame:
    """The newest record of each key, tombstones included; all columns.

    One aggregate with partial results before the shuffle, so a hot key sends one row for each task.  Records with
    equal key and sequence are one record replayed: see :func:`_newest`.
    """
    rest = [c for c in log.columns if c != "key"]
    order = [o.alias(f"o{i}") for i, o in enumerate(_newest(log))]
    won = log.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__won"))
    return won.select("key", "__won.*").select(*log.columns)


def latest_by_window(log: DataFrame) -> DataFrame:
    """The same as :func:`latest` by a window; the two plans check each other in tests."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*[o.desc() for o in _newest(log)]))
    return log.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def signed_size() -> Column:
    """A record's size, below zero for a tombstone."""
    return F.when(F.col("tomb"), -record_size()).otherwise(record_size())


def live(log: DataFrame) -> DataFrame:
    """Newest records that are no tombstones."""
    return latest(log).where(~F.col("tomb"))


def index_view(log: DataFrame) -> DataFrame:
    """(key, seq, tomb, size) of newest records, tombstones included; values are not carried through the shuffle.

    A tombstone's size is negated for the aggregate, whose buffers are then plain numbers that hash in place.
    """
    won = log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(signed_size(), "seq").alias("s"))
    return won.select("key", "seq", (F.col("s") < 0).alias("tomb"), F.abs("s").alias("size"))


def _finished(log: DataFrame) -> DataFrame:
    return log.where("batch").groupBy("batch_id").agg(F.max("batch_end").alias("done"))


def batch_gate(log: DataFrame) -> DataFrame:
    """Records outside batches, and members of batches whose last record is there; an unfinished batch is left out.

    A null batch_id on a batch record belongs to no finished batch.
    """
    done = _finished(log).where("done").select("batch_id")
    plain, members = log.where("not coalesce(batch, false)"), log.where("batch")
    return plain.unionByName(members.join(done, "batch_id", "left_semi").select(*log.columns))


def unfinished_batches(log: DataFrame) -> DataFrame:
    """(batch_id, records) of batches without their last record."""
    return log.where("batch").groupBy("batch_id").agg(F.count("*").alias("records"), F.max("batch_end").alias("done")).where("not done").drop("done")


def strip_batches(log: DataFrame) -> DataFrame:
    """The same records outside any batch."""
    return log.withColumns({"batch": F.lit(False), "batch_end": F.lit(False), "batch_id": F.lit(None).cast("long")})


def compact_log(log: DataFrame) -> DataFrame:
    """What a full compaction keeps: live records with their own sequence numbers, outside any batch."""
    return strip_batches(live(log))


def same_seq_conflicts(log: DataFrame) -> DataFrame:
    """Keys and sequence numbers under which different records stand; empty for a sound log."""
    body = F.xxhash64("tomb", "value")
    return log.groupBy("key", "seq").agg(F.min(body).alias("a"), F.max(body).alias("b")).where("a <> b").select("key", "seq")

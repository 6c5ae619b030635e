"""Point reads, ordered ranges, pages, snapshots and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DAMAGED, CorruptRecord, NeedFullSync, record_crc
from ..functions.tables import materialize
from .state import live, strip_batches

__all__ = ["get", "in_range", "within", "scan_range", "scan_capped", "next_page", "snapshot", "records_since", "verified", "elect", "MAX_RANGE_RESULTS"]

#: Rows of a capped range, unless said otherwise.
MAX_RANGE_RESULTS = 100_000


def get(log: DataFrame, key) -> DataFrame:
    """The live record of a key: one row or none.  The key filter reaches the scan, below the aggregate."""
    return live(log.where(F.col("key") == F.lit(key))).select("key", "seq", "value")


def in_range(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows with start <= key <= end, both inclusive; None or empty is no bound; an inverted range is empty."""
    return df.where(within(start, end))


def within(start=None, end=None) -> Column:
    """The condition of :func:`in_range`."""
    out = F.col("key") >= F.lit(start) if start else F.lit(True)
    return out & (F.col("key") <= F.lit(end)) if end else out


def scan_range(log: DataFrame, start=None, end=None, limit: int = 0) -> DataFrame:
    """Live records of a range in ascending bytewise order of keys; limit <= 0 is none."""
    out = live(in_range(log, start, end)).select("key", "seq", "value").orderBy("key")
    return out.limit(limit) if limit > 0 else out


def scan_capped(log: DataFrame, start=None, end=None, limit: int = 0, cap: int = MAX_RANGE_RESULTS) -> tuple[DataFrame, bool]:
    """A range of at most ``cap`` rows, and whether there are more than were given.  The range is read once."""
    n = min(limit, cap) if limit > 0 else cap
    out = materialize(scan_range(log, start, end, n + 1))
    return out.orderBy("key").limit(n), out.count() > n


def next_page(log: DataFrame, after, end=None, limit: int = 0) -> DataFrame:
    """The page that follows the last key of the page before."""
    out = live(in_range(log, None, end).where(F.col("key") > F.lit(after))).select("key", "seq", "value").orderBy("key")
    return out.limit(limit) if limit > 0 else out


def snapshot(log: DataFrame) -> DataFrame:
    """One live record for each key in order of keys, outside any batch."""
    return strip_batches(live(log)).orderBy("key")


def records_since(log: DataFrame, seq: int, merge_seq: int = 0) -> DataFrame:
    """All records after ``seq``, or :class:`NeedFullSync` if a compaction has dropped some of them."""
    if seq < merge_seq:
        raise NeedFullSync(f"records up to {merge_seq} were compacted; {seq} is before that")
    return log.where(F.col("seq") > seq)


def verified(log: DataFrame, mode: str = "fail") -> DataFrame:
    """Records whose column crc matches; others fail the read, or are left out with mode ``skip``."""
    right = F.coalesce(F.col("crc") == record_crc(log), F.lit(False))
    if mode == "skip":
        return log.where(right)
    if mode != "fail":
        raise CorruptRecord(f"mode is {mode}, not fail or skip")
    return log.where(F.assert_true(right, F.lit(DAMAGED)).isNull())


def elect(votes: DataFrame, nodes: int) -> DataFrame:
    """The candidate to lead: highest seq, then lowest id; none without votes of a majority of ``nodes``."""
    best = F.min_by(F.struct("id", "seq"), F.struct(-F.col("seq"), F.col("id"))).alias("best")
    return votes.agg(best, F.count("*").alias("n")).where(F.col("n") * 2 > nodes).select("best.id", "best.seq")

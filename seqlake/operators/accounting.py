"""Space accounting: what is live, what is dead, and whether a compaction is worth it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import record_size
from .state import signed_size

__all__ = ["space", "should_compact", "COMPACTION_THRESHOLD"]

#: Share of dead bytes from which a compaction is worth it.
COMPACTION_THRESHOLD = 0.4


def space(log: DataFrame) -> DataFrame:
    """(keys, tombstones, live_bytes, dead_bytes, total_bytes, reclaimable, max_seq, records): one row, zeros if empty.

    One pass: each key's bytes and newest record come from one aggregate.
    """
    keys = log.groupBy("key").agg(F.max_by(signed_size(), "seq").alias("won"), F.sum(record_size()).alias("bytes"), F.count("*").alias("n"), F.max("seq").alias("seq"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sums = keys.agg(
        F.count_if(F.col("won") > 0).alias("keys"), F.count_if(F.col("won") < 0).alias("tombstones"), zero(F.sum(F.greatest("won", F.lit(0)))).alias("live_bytes"),
        zero(F.sum("bytes")).alias("total_bytes"), zero(F.max("seq")).alias("max_seq"), zero(F.sum("n")).alias("records"),
    )
    dead = F.greatest(F.col("total_bytes") - F.col("live_bytes"), F.lit(0))
    ratio = F.when(F.col("live_bytes") + dead == 0, F.lit(0.0)).otherwise(F.round(dead / (F.col("live_bytes") + dead), 3))
    return sums.select("keys", "tombstones", "live_bytes", dead.alias("dead_bytes"), "total_bytes", ratio.alias("reclaimable"), "max_seq", "records")


def should_compact(log: DataFrame, files: int, threshold: float = COMPACTION_THRESHOLD) -> DataFrame:
    """(should_compact): one row; true if there are two files or more and enough of their bytes are dead."""
    s = space(log)
    whole = F.col("live_bytes") + F.col("dead_bytes")
    return s.select((F.lit(files >= 2) & (whole > 0) & (F.col("dead_bytes") >= F.lit(threshold) * whole)).alias("should_compact"))

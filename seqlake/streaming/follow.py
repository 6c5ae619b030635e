"""Following a store, and newest-wins state over a stream of records.

No watermark is set anywhere: a record is never too late, it only loses against a newer one, and tombstones stay in the
state because an older put may still come.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store

__all__ = ["catch_up", "follow", "read_log_stream", "stream_latest", "keep_latest"]


def catch_up(source: Store, replica: Store, at_seq: int) -> int:
    """Bring ``replica``, which has everything up to ``at_seq``, to the source's present version; returns its number.

    A follower that compaction has left behind, or that is ahead of the source, starts over from a snapshot, which takes
    the place of what it has in one version.
    """
    mode, records, top = source.feed(at_seq)
    if top == at_seq and mode == "incremental":
        return at_seq
    (replica.replace if mode == "full" else replica.apply)(records, txn=f"{mode}-{at_seq}-{top}")
    return top


def follow(source: Store, replica: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A query that applies each new version of ``source`` to ``replica``; it goes on from its checkpoint.

    The stream is that of published versions, so it never sees half a commit.  Applying is idempotent: a batch that is
    run again finds its transaction done.  The replica's number is kept beside it, as of the source's version.
    """
    spark = source.spark

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            have = replica.version()
            catch_up(source, replica, max((int(t.rsplit("-", 1)[1]) for t in have.txn_ids if t.startswith(("incremental-", "full-"))), default=0))

    versions = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "v*.json").load(f"{source.path}/_manifest")
    writer = versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def read_log_stream(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Records of Parquet files as they come; ``max_files`` a batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_latest(stream: DataFrame) -> DataFrame:
    """Newest record of each key over a stream, tombstones included; for update mode."""
    rest = [c for c in stream.columns if c != "key"]
    won = stream.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct(F.col("seq"), F.xxhash64(*rest))).alias("won"))
    return won.select("key", "won.*")


def keep_latest(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A query that keeps the newest records of ``stream`` in ``store``; it goes on from its checkpoint.

    Each trigger sends on the keys that changed, and nothing is gathered: the store has all of them.  A trigger that runs
    again finds its transaction done.
    """
    name = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex

    def apply(batch: DataFrame, number: int) -> None:
        store.apply(batch, txn=f"latest-{name}-{number}")

    writer = stream_latest(stream).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()

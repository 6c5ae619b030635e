"""A store: a log on Parquet in numbered versions, and the state that it stands for.

A commit is one folder of Parquet files and one new version.  Readers pin a version, so what they see does not move.
Appending commits never conflict for good: the loser of a race takes the next version.  Storage must offer an exclusive
publish step (see :mod:`.manifest`).
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import operators as op
from ..functions import BatchMismatch, CommitConflict, CorruptRecord, KeyNotFound, StoreClosed, fault_of, faults, log_schema, raise_fault, record_crc, record_size, refused, sound
from ..functions.tables import drop_table, materialize, numbered
from .manifest import Manifest, Version

#: Records in a file, and bytes of keys and values in it, at most (the latter by the mean size of a commit's records).
RECORDS_PER_FILE, BYTES_PER_FILE = 5_000_000, 256 << 20


class Store:
    """A handle on the store in folder ``path``; ``kind`` is the type of keys and values (binary or string)."""

    def __init__(self, spark: SparkSession, path: str, kind: T.DataType | None = None, threshold: float = op.COMPACTION_THRESHOLD, max_range: int = op.MAX_RANGE_RESULTS, tries: int = 20, file_bytes: int = BYTES_PER_FILE):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), log_schema(kind)
        self.kind, self.threshold, self.max_range, self.tries, self.file_bytes = self.schema["key"].dataType, threshold, max_range, tries, file_bytes
        self.manifest, self.closed = Manifest(spark, self.path), False
        self.counters = dict.fromkeys(("puts", "gets", "misses", "deletes", "scans", "compactions"), 0)
        self.observers: list[Callable[[int, DataFrame], None]] = []
        self._merge: threading.Thread | None = None
        self._merge_error: Exception | None = None

    # -- versions

    def _open(self) -> None:
        if self.closed:
            raise StoreClosed(self.path)

    def version(self) -> Version:
        self._open()
        return self.manifest.read()

    def log(self, at: Version | None = None, after_commit: int = 0, where: Column | None = None, verify: str = "fail", commits: bool = False) -> DataFrame:
        """All records of a version (the newest one unless given), of commits after ``after_commit``.

        Records for which ``where`` holds are compared with their checksums; one that does not match fails the job, or
        is left out with ``verify="skip"``; ``verify="no"`` is for what reads no values.  ``commits`` adds commit_id.
        """
        at = at or self.version()
        stored = T.StructType([*self.schema.fields, T.StructField("crc", T.LongType()), T.StructField("commit_id", T.LongType())])
        names = [*self.schema.names, *(["commit_id"] if commits else [])]
        paths = [f"{self.path}/{c['path']}" for c in at.commits if c["id"] > after_commit]
        if not paths:
            return self.spark.createDataFrame([], stored).select(*names)
        rows = self.spark.read.schema(stored).parquet(*paths)
        rows = rows if where is None else rows.where(where)
        return (rows if verify == "no" else op.verified(rows, verify)).select(*names)

    def checked(self, at: Version | None = None, mode: str = "fail") -> DataFrame:
        """All records, each against its checksum; ``mode`` is fail or skip."""
        return self.log(at, verify=mode)

    def _resolve(self, at: Version | None = None, where: Column | None = None) -> DataFrame:
        """The records from which state is made: they say which commit they are of, so that the first of replays counts."""
        return self.log(at, where=where, commits=True)

    def _write(self, records: DataFrame, commit: int, by_key: bool = False, size: float | None = None) -> dict:
        """A commit's folder; what is written under a name that loses its race is never named again.

        ``size`` is what a record is known to have in bytes; else the first records say.  Counts are taken while writing.
        """
        name = f"data/c{commit:010d}-{uuid.uuid4().hex}"
        out = records.select(*self.schema.names).withColumn("commit_id", F.lit(commit).cast("long"))
        out = out.withColumn("crc", record_crc(out))
        if size is None:
            size = out.limit(1000).agg(F.avg(record_size())).first()[0]
        if by_key:
            out = out.repartitionByRange("key").sortWithinPartitions("key")
        seen = Observation()
        out = out.observe(seen, F.count(F.lit(1)).alias("n"), F.max("seq").alias("seq"), F.sum(record_size()).alias("bytes"))
        per_file = max(1, min(RECORDS_PER_FILE, int(self.file_bytes / max(1.0, size or 1.0))))
        writer = out.write.option("maxRecordsPerFile", per_file).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(min(per_file, 1_000_000)))
        writer.parquet(f"{self.path}/{name}")
        got = seen.get
        return {"id": commit, "path": name, "records": got.get("n") or 0, "max_seq": got.get("seq") or 0, "bytes": got.get("bytes") or 0}

    def _append(self, make: Callable[[Version, int], DataFrame], txn: str | None, replace: bool = False) -> tuple[Version, bool]:
        """Publish the records that ``make`` gives for a version; on a lost race make them anew for the next one.

        With ``replace`` they are all that the new version has, and numbers start anew with them.
        """
        for _ in range(self.tries):
            at = self.version()
            if txn and self.manifest.knows(at, txn):
                return at, False
            base = max(at.last_seq, at.merge_seq)
            with sound():
                records = make(at, base)
                commit = self._write(records, at.next_commit)
            if not commit["records"] and not replace:
                return at, False
            top, txns = commit.pop("max_seq"), [*at.txn_ids, *([txn] if txn else [])]
            if replace:
                new = Version(at.version + 1, [commit] if commit["records"] else [], top, 0, txns, at.next_commit + 1)
            else:
                new = Version(at.version + 1, [*at.commits, commit], max(base, top), at.merge_seq, txns, at.next_commit + 1)
            try:
                self.manifest.publish(new)
            except CommitConflict:
                continue
            for f in self.observers:
                f(new.last_seq, self.log(new, at.next_commit - 1))
            return new, True
        raise CommitConflict(f"lost {self.tries} races for {self.path}")

    # -- writes

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema.replace("KIND", self.kind.simpleString()))

    def put(self, key, value, txn: str | None = None) -> int:
        """Write one pair; returns the sequence number.  Bulk writes belong in :meth:`batch_put`."""
        return self.batch_put([key], [value], txn, batch=False)

    def batch_put(self, keys: list | DataFrame, values: list | None = None, txn: str | None = None, order: str = "ord", batch: bool = True) -> int:
        """Write all pairs or none; returns the newest sequence number.

        Takes two lists, or a DataFrame with key, value and a column ``order``; of equal keys the last in order wins.
        An invalid pair rejects all before anything is published; nothing at all is no commit.  A ``txn`` that was
        published is done already.  A DataFrame is read once, validated and numbered on the way, and written once more.
        """
        if isinstance(keys, DataFrame):
            rows = keys.select("key", F.coalesce("value", F.lit("").cast(self.kind)).alias("value"), F.col(order).alias("ord"))
            try:
                placed, n = numbered(rows.where(refused(faults())), "ord", name="pos")
            except Exception as e:
                raise_fault(fault_of(e))
                raise
        else:
            if len(keys) != len(values or []):
                raise BatchMismatch(f"{len(keys)} keys and {len(values or [])} values")
            n, placed = len(keys), self._frame([(k, v, i) for i, (k, v) in enumerate(zip(keys, values, strict=True), 1)], "key KIND, value KIND, pos long")
            bad = placed.where(faults().isNotNull()).select(faults().alias("fault")).first()
            raise_fault(bad and bad["fault"])
            placed = placed.withColumn("value", F.coalesce("value", F.lit("").cast(self.kind)))
        if not n:
            return self.seq()
        new, done = self._append(lambda at, base: op.records_of(placed, base, n, at.next_commit if batch else None, time.time_ns()), txn)
        if done:
            self.counters["puts"] += new.commits[-1]["records"]
        return new.last_seq

    def delete(self, key, txn: str | None = None) -> int:
        """Delete a live key; :class:`KeyNotFound`, and no record, if it is missing or deleted."""
        raise_fault("empty key" if not key else None)
        own = F.col("key") == F.lit(key)
        new, done = self._append(lambda at, base: op.tombstones(self._resolve(at, own), self._frame([(key,)], "key KIND"), base, time.time_ns()), txn)
        if not done and not (txn and self.manifest.knows(new, txn)):
            raise KeyNotFound(key)
        self.counters["deletes"] += done
        return new.last_seq

    def delete_all(self, keys: DataFrame, txn: str | None = None) -> DataFrame:
        """Delete those of ``keys`` that are live; returns the others, as of the version that the tombstones follow."""
        missing: list[DataFrame] = []

        def make(at: Version, base: int) -> DataFrame:
            missing[:] = [materialize(op.missing_keys(self._resolve(at), keys))]
            return op.tombstones(self._resolve(at), keys, base, time.time_ns())

        new, done = self._append(make, txn)
        self.counters["deletes"] += new.commits[-1]["records"] if done else 0
        return missing[0] if missing else keys.select("key").distinct().limit(0)

    def apply(self, records: DataFrame, txn: str | None = None) -> int:
        """Add records of another log with their own numbers; one bad record rejects all.  Repeats and order don't matter."""
        return self._append(lambda at, base: self._sound(records), txn)[0].last_seq

    def replace(self, records: DataFrame, txn: str | None = None) -> int:
        """Have ``records`` instead of all that is there, in one version: no reader sees the store empty in between."""
        return self._append(lambda at, base: self._sound(records), txn, replace=True)[0].last_seq

    def _sound(self, records: DataFrame) -> DataFrame:
        records = records.select(*[c for c in (*self.schema.names, "crc") if c in records.columns])
        wrong = faults().isNotNull() | F.col("seq").isNull() | (F.col("seq") < 1) | F.col("tomb").isNull()
        if "crc" in records.columns:
            wrong = wrong | ~F.coalesce(F.col("crc") == record_crc(records), F.lit(False))
        with sound():
            if not records.where(wrong).isEmpty():
                raise CorruptRecord("a record to apply is not valid")
        return records

    def reset(self) -> None:
        """Drop everything; numbers start anew."""
        at = self.version()
        self.manifest.publish(Version(at.version + 1, next_commit=at.next_commit))

    # -- reads

    def get(self, key) -> bytes | str:
        """The value of a key, or :class:`KeyNotFound`."""
        raise_fault("empty key" if not key else None)
        self.counters["gets"] += 1
        with sound():
            row = op.get(self._resolve(where=F.col("key") == F.lit(key)), key).first()
        if row is None:
            self.counters["misses"] += 1
            raise KeyNotFound(key)
        return bytes(row["value"]) if isinstance(row["value"], bytearray) else row["value"]

    def scan(self, start=None, end=None, limit: int = 0) -> DataFrame:
        """Live pairs of the inclusive range in order of keys.  A damaged record of the range fails the job that reads it."""
        self.counters["scans"] += 1
        return op.scan_range(self._resolve(where=op.within(start, end)), start, end, limit)

    def read_key_range(self, start=None, end=None, limit: int = 0) -> tuple[list[Row], bool]:
        """At most ``max_range`` pairs of a range, and whether there are more."""
        self.counters["scans"] += 1
        n = min(limit, self.max_range) if limit > 0 else self.max_range
        with sound():
            rows = op.scan_range(self._resolve(where=op.within(start, end)), start, end, n + 1).collect()
        return rows[:n], len(rows) > n

    def scan_key_range(self, start=None, end=None, limit: int = 0) -> Iterator[Row]:
        """Pairs of a range one by one; stop when you like."""
        return self.scan(start, end, limit).toLocalIterator()

    def state(self) -> DataFrame:
        return op.live(self._resolve()).drop("commit_id")

    def __len__(self) -> int:
        return op.index_view(self.log(verify="no")).where("not tomb").count()

    def seq(self) -> int:
        at = self.version()
        return max(at.last_seq, at.merge_seq)

    def merge_seq(self) -> int:
        return self.version().merge_seq

    def ping(self) -> bool:
        self._open()
        return True

    def stats(self) -> dict:
        """Space accounting, counters of this handle, and the version."""
        at = self.version()
        return op.space(self.log(at, verify="no")).first().asDict() | self.counters | {"seq": max(at.last_seq, at.merge_seq), "merge_seq": at.merge_seq, "files": len(at.commits), "version": at.version}

    def info(self) -> dict:
        at = self.version()
        return {"path": self.path, "seq": max(at.last_seq, at.merge_seq), "keys": len(self), "version": at.version}

    # -- feeds

    def snapshot(self) -> DataFrame:
        return op.snapshot(self._resolve()).drop("commit_id")

    def records_since(self, seq: int) -> DataFrame:
        at = self.version()
        return op.records_since(self.log(at, where=F.col("seq") > seq), seq, at.merge_seq)

    def feed(self, from_seq: int) -> tuple[str, DataFrame, int]:
        """(mode, records, as_of_seq): what a follower at ``from_seq`` needs; mode is incremental or full.

        All of it is of one version.  A follower keeps as_of_seq, which may be beyond the newest record it got.
        """
        at = self.version()
        top = max(at.last_seq, at.merge_seq)
        if from_seq <= 0 or from_seq < at.merge_seq or from_seq > top:
            return "full", op.snapshot(self._resolve(at)).drop("commit_id"), top
        return "incremental", op.records_since(self.log(at, where=F.col("seq") > from_seq), from_seq, at.merge_seq), top

    def add_observer(self, f: Callable[[int, DataFrame], None]) -> None:
        """Call ``f(newest seq, records)`` after each commit of this handle."""
        self.observers.append(f)

    # -- compaction

    def should_compact(self) -> bool:
        at = self.version()
        return op.should_compact(self.log(at, verify="no"), len(at.commits), self.threshold).first()[0]

    def compact(self) -> Version:
        """Rewrite all commits of the present version as one with live records only, sorted by key.

        Tombstones may go because every commit takes part.  Commits that come meanwhile stay as they are; another
        compaction or a reset meanwhile is a :class:`CommitConflict`.  A damaged record is a :class:`CorruptRecord`, and
        nothing is published: its checksum is not made anew.
        """
        pinned = self.version()
        barrier = max(pinned.last_seq, pinned.merge_seq)
        have = sum(c["records"] for c in pinned.commits)
        with sound():
            # Sorting by ranges samples what it sorts, so the winners are found once and kept.
            live = materialize(op.compact_log(self._resolve(pinned)).select(*self.schema.names))
            merged = self._write(live, pinned.next_commit, by_key=True, size=sum(c.get("bytes", 0) for c in pinned.commits) / have if have else None)
        drop_table(live)
        merged.pop("max_seq")
        old = {c["path"] for c in pinned.commits}
        for _ in range(self.tries):
            at = self.version()
            if at.merge_seq != pinned.merge_seq or not old <= {c["path"] for c in at.commits}:
                raise CommitConflict("another compaction or a reset came first")
            kept = [c for c in at.commits if c["path"] not in old]
            new = Version(at.version + 1, [{**merged, "id": pinned.commits[-1]["id"] if pinned.commits else 0}, *kept] if merged["records"] else kept, at.last_seq, barrier, at.txn_ids, at.next_commit + 1)
            try:
                self.manifest.publish(new)
            except CommitConflict:
                continue
            self.counters["compactions"] += 1
            return new
        raise CommitConflict(f"lost {self.tries} races for {self.path}")

    def maybe_compact(self) -> bool:
        return bool(self.should_compact() and self.compact())

    def start_compaction(self) -> bool:
        """Compact in the background; False if that is going on already.  An error of it is raised by the next call here, or by :meth:`close`."""
        if self.compacting():
            return False
        self._raise_merge_error()

        def merge() -> None:
            try:
                self.compact()
            except Exception as e:  # noqa: BLE001
                self._merge_error = e

        self._merge = threading.Thread(target=merge, daemon=True)
        self._merge.start()
        return True

    def compacting(self) -> bool:
        return bool(self._merge and self._merge.is_alive())

    def _raise_merge_error(self) -> None:
        error, self._merge_error = self._merge_error, None
        if error:
            raise error

    def vacuum(self, keep_versions: int = 1, older_than_s: float = 3600) -> int:
        """Delete folders of data that none of the newest ``keep_versions`` versions names; returns how many.

        Folders younger than ``older_than_s`` stay: a writer may be about to publish them.
        """
        numbers = self.manifest.numbers()[-keep_versions:]
        named = {c["path"] for n in numbers for c in self.manifest.read(n).commits}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        if not self.manifest.fs.exists(path):
            return 0
        loose = [s.getPath() for s in self.manifest.fs.listStatus(path) if f"data/{s.getPath().getName()}" not in named and s.getModificationTime() / 1000 <= time.time() - older_than_s]
        for p in loose:
            self.manifest.fs.delete(p, True)
        return len(loose)

    def close(self) -> None:
        if self._merge:
            self._merge.join()
        self.closed = True
        self._raise_merge_error()
